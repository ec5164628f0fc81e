"""Near-duplicate documents: many universal hash minima, bands, exact confirmation, components.

1. Each text becomes the set of its distinct word shingles (64-bit hashes).  Texts with one and the same
   set form a class; from here on only the smallest id of a class takes part.
2. A set's signature holds the minima of ``BANDS * ROWS`` universal hash functions.  Equal bands put sets
   into one bucket.  At a similarity of 0.8 a pair shares no band with a chance of 5e-6.
3. Every member of a bucket is compared with the bucket's smallest id on full sets.
4. Links between two other members may remain.  In buckets whose members are not yet in one component,
   every member outside the largest part is compared with the members of other parts, block against
   block: so no link of a bucket is lost, and no bucket meets in one task.
5. Components come from alternating large-star and small-star.

Rows with a null id take no part and are not returned; null or blank texts have an empty set and link with
nothing; of rows that repeat an id the smallest text stands; only id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .staging import free_shuffles, one_text_per_id, release, stage

ROWS, BANDS = 6, 40
#: Members of a bucket that are compared together in one task.
BLOCK = 1024

_SETS = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_26).integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def _signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` bucket keys for each non-empty set."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    keys = np.zeros((len(starts), BANDS), np.uint64)
    if len(starts) == 0:
        return keys
    a, b = _functions(ROWS * BANDS)
    work = np.empty_like(sets)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            np.multiply(sets, a[i], out=work)
            work += b[i]
            key = W.mix(key ^ (np.minimum.reduceat(work, starts) >> np.uint64(20)))
        keys[:, band] = key
    return keys


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offsets = W.text_bytes(part.column(1))
                sets, counts = W.shingles(*W.words(data, offsets), width)
                ends = np.cumsum(counts)
                digests = [blake2b(sets[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(ends, counts)]
                sizes = np.where(counts > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                    pa.array(_signatures(sets, counts).view(np.int64).ravel()),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(digests, pa.binary()), bands],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offsets = W.text_bytes(part.column(1))
                sets, counts = W.shingles(*W.words(data, offsets), width)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(sets.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "shingles"])

    return run


def _similar(n_both, n_a, n_b, percent: int):
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _block_links(percent: int):
    """Links of the querying members of one block with the other members, as far as they join new parts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, part = group["doc_id"].to_numpy(), group["part"].to_numpy().copy()
        size = group["shingles"].map(len).to_numpy()
        _, code = np.unique(np.concatenate(list(group["shingles"])), return_inverse=True)
        starts = np.cumsum(size) - size
        there = np.zeros(code.max() + 1, np.uint8)
        out = []
        for i in np.flatnonzero(group["query"].to_numpy()):
            own = code[starts[i] : starts[i] + size[i]]
            there[own] = 1
            both = np.add.reduceat(there[code], starts, dtype=np.int64)
            there[own] = 0
            linked = np.flatnonzero(_similar(both, size[i], size, percent) & (part != part[i]))
            for j in linked:
                if part[j] != part[i]:
                    out.append((ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Two documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; the component id is the smallest id reachable, and that document is kept.
    """
    docs = one_text_per_id(docs)
    signed = stage(docs.mapInArrow(_describe(width), _SETS), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).select(
        "doc_id", "bands"
    )
    banded = reps.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stage(banded.join(shared, "bucket"), "buckets")
    free_shuffles(docs.sparkSession)
    wanted = members.select("doc_id").distinct()
    sets = stage(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(width), "doc_id long, shingles array<long>"), "sets")

    pairs = members.where("doc_id <> hub").select("doc_id", "hub").distinct()
    hubs = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("shingles", "other"))
    links = stage(
        pairs.join(sets, "doc_id").join(hubs, "hub")
        .where(_similar(both, F.size("shingles"), F.size("other"), percent))
        .select(F.col("doc_id").alias("a"), F.col("hub").alias("b")),
        "links",
    )
    free_shuffles(docs.sparkSession)
    parts = stage(components(links), "parts")

    placed = (
        members.where("n > 2 and doc_id <> hub")
        .join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    )
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    open_ = stage(
        sizes.groupBy("bucket")
        .agg(F.max_by("part", "n").alias("main"), F.count("*").alias("parts"), F.sum("n").alias("members"))
        .where("parts > 1"),
        "open-buckets",
    )
    left = placed.join(open_, "bucket").select(
        "bucket", "doc_id", "part", (F.col("part") != F.col("main")).alias("query"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # Each block of queries meets each block of members; in its own block a member is there once.
    asked = left.where("query").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    told = left.withColumn("of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = (
        asked.where("block <> with").select("bucket", F.col("block").alias("of"), "with", "doc_id", "part", F.lit(True).alias("query"))
        .unionByName(told.select("bucket", "of", F.col("block").alias("with"), "doc_id", "part", F.expr("query and of = block").alias("query")))
    )
    more = met.join(sets, "doc_id").groupBy("bucket", "of", "with").applyInPandas(_block_links(percent), "a long, b long")
    more = stage(more, "links")
    final = stage(components(links.unionByName(more)), "components")
    release(members, sets, links, more, parts, open_)

    rep = signed.where("digest is not null").select("doc_id", "n_shingles", "digest").join(classes, "digest")
    known = rep.join(final, rep.rep == final.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    empty = signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))
