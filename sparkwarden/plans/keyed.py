"""Keyed state that grows by small versions: buckets of keys, a Bloom filter per bucket, compaction.

A table's folder holds

    rows/v=…/bucket=…          the rows that one run has written
    filters/v=…/bucket=…       the filter words of those rows
    sizes/….json               how many rows, buckets and filter words a version has
    bases/….json               compacted versions: which versions a base holds

A run writes only its own rows.  A lookup first keeps the buckets that its keys fall into, reads their filters,
and then reads the buckets, version by version, in which the filters leave a chance of a hit.  Buckets are hashes of whole
keys, so no bucket is hot, whatever one account or repository owns; their number is a power of two that follows
the rows of the version.

A filter has one 64-bit word per few keys; a key sets ``BITS`` bits of one word.  Filters are a table like any other:
words meet keys in a join, nothing of them is collected.  What is collected are bucket numbers, at most
``MOST_BUCKETS``.

Compaction writes all versions that count as one base, the surviving row per key, sorted by key.  The base counts once its
file in ``bases`` is there; versions that it holds are read no more, and later ones, of slower runs too, stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import claims

BITS, BITS_PER_KEY = 6, 16
ROWS_PER_BUCKET = 1 << 20
MOST_BUCKETS = 1 << 15


@dataclass(frozen=True)
class Source:
    """A version or base: the name of its folders, its rows, its buckets and the filter words of each."""

    name: str
    rows: int
    buckets: int
    words: int


class KeyTable:
    """Rows with one surviving row per key.

    ``order`` are columns: of several rows of a key the one with the largest values survives, ``keep_first`` columns
    keep the value of the smallest instead.  Rows of a key that agree in all of ``order`` count as one.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], order: Sequence[str] = (),
        keep_first: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
    ):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.keys, self.order, self.keep_first = list(keys), list(order), list(keep_first)
        self.columns = spark.createDataFrame([], schema).columns
        self.rows_per_bucket = rows_per_bucket

    # ------------------------------------------------------------ keys
    def _hash(self, salt: int) -> Column:
        return F.xxhash64(F.lit(salt), *self.keys)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(self._hash(0), F.lit(buckets)).cast("int")

    def _mask(self) -> Column:
        """The bits of a key, six of each 64 from one hash."""
        h, one = self._hash(2), F.lit(1).cast("long")
        bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(BITS)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    # ------------------------------------------------------------ versions
    def append(self, rows: DataFrame, version: int) -> None:
        """Writes the rows of one run; a repeated run overwrites its own."""
        rows = rows.select(*self.columns)
        self._write(rows, f"{version:010d}", rows.count())

    def _write(self, rows: DataFrame, name: str, about: int) -> None:
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * self.rows_per_bucket < about:
            buckets *= 2
        path, parts = f"{self.folder}/rows/v={name}", ["bucket", *self.keys]
        placed = rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket").sortWithinPartitions(*parts)
        placed.write.partitionBy("bucket").mode("overwrite").parquet(path)
        written = self._read("rows", name)
        n = written.count()
        words = max(1, -(-n * BITS_PER_KEY // (64 * buckets)))
        filters = written.select("bucket", F.pmod(self._hash(1), F.lit(words)).alias("word"), self._mask().alias("mask"))
        filters = filters.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        filters.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/filters/v={name}")
        size = {"name": name, "rows": n, "buckets": buckets, "words": words}
        claims.write_whole(self.spark, f"{self.folder}/sizes/{name}-{uuid.uuid4().hex}.json", size)

    def _read(self, kind: str, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = f"{self.schema}, bucket int" if kind == "rows" else "word long, bits long, bucket int"
        path = f"{self.folder}/{kind}/v={name}"
        there = {n for n in claims.names(self.spark, path) if n.startswith("bucket=")}
        if buckets is not None:
            there &= {f"bucket={b}" for b in buckets}
        if not there:
            return self.spark.createDataFrame([], schema)
        # Only the folders of these buckets are listed and read.
        return self.spark.read.option("basePath", path).schema(schema).parquet(*(f"{path}/{n}" for n in sorted(there)))

    def sources(self, versions: Sequence[int]) -> list[Source]:
        """The largest base of versions that count, and the versions beyond it."""
        sizes = {}
        for file in claims.names(self.spark, f"{self.folder}/sizes"):
            if file.endswith(".json"):
                size = claims.read_whole(self.spark, f"{self.folder}/sizes/{file}")
                sizes[size["name"]] = Source(**size)
        counted, best = set(versions), {"name": None, "holds": []}
        for file in claims.names(self.spark, f"{self.folder}/bases"):
            if file.endswith(".json"):
                base = claims.read_whole(self.spark, f"{self.folder}/bases/{file}")
                if set(base["holds"]) <= counted and len(base["holds"]) > len(best["holds"]):
                    best = base
        listed = [best["name"]] if best["name"] else []
        listed += [f"{v:010d}" for v in sorted(counted - set(best["holds"]))]
        return [sizes[name] for name in listed if name in sizes and sizes[name].rows]

    # ------------------------------------------------------------ lookups
    def hit_buckets(self, keys: DataFrame, versions: Sequence[int]) -> dict[str, list[int]]:
        """Buckets of each source that may hold one of the keys; no others need be read."""
        sources = self.sources(versions)
        if not sources:
            return {}
        # Powers of two: the buckets among the most numerous ones tell those of all others.
        most, number = max(s.buckets for s in sources), {s.name: i for i, s in enumerate(sources)}
        asked = keys.select(self._bucket(most).alias("b"), self._hash(1).alias("h"), self._mask().alias("mask")).distinct()
        fallen = [r.b for r in asked.select("b").distinct().collect()]
        filters = [
            self._read("filters", s.name, {b % s.buckets for b in fallen}).withColumn("source", F.lit(number[s.name])) for s in sources
        ]
        every = F.array(*(
            F.struct(F.lit(number[s.name]).alias("source"), F.pmod("b", F.lit(s.buckets)).alias("bucket"), F.pmod("h", F.lit(s.words)).alias("word"))
            for s in sources
        ))
        asked = asked.select("mask", F.inline(every))
        met = asked.join(reduce(DataFrame.unionByName, filters), ["source", "bucket", "word"])
        met = met.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        hits = met.select("source", "bucket").distinct().collect()
        return {s.name: sorted(r.bucket for r in hits if r.source == number[s.name]) for s in sources}

    def _candidates(self, keys: DataFrame, versions: Sequence[int]) -> DataFrame:
        parts = [self._read("rows", name, buckets) for name, buckets in self.hit_buckets(keys, versions).items() if buckets]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, parts).select(*self.columns)

    def unseen(self, listed: DataFrame, versions: Sequence[int]) -> DataFrame:
        """The listed rows whose key no counted version has."""
        return listed.join(self._candidates(listed, versions).select(*self.keys), self.keys, "left_anti")

    def lookup(self, keys: DataFrame, versions: Sequence[int]) -> DataFrame:
        """The surviving rows of the given keys."""
        found = self._candidates(keys, versions)
        return self._survivors(found.join(keys.select(*self.keys).distinct(), self.keys, "left_semi"))

    def read(self, versions: Sequence[int]) -> DataFrame:
        """The surviving row of every key."""
        parts = [self._read("rows", s.name) for s in self.sources(versions)]
        every = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)
        return self._survivors(every)

    def _survivors(self, rows: DataFrame) -> DataFrame:
        if not self.order:
            return rows.select(*self.columns).distinct()
        order = F.struct(*self.order)
        pick = [(F.min_by if c in self.keep_first else F.max_by)(c, order).alias(c) for c in self.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(*pick).select(*self.columns)

    # ------------------------------------------------------------ compaction
    def compact(self, versions: Sequence[int]) -> str | None:
        """One base of all counted versions; results stay as they were."""
        sources = self.sources(versions)
        if len(sources) < 2:
            return None
        name = f"base-{uuid.uuid4().hex}"
        self._write(self.read(versions), name, sum(s.rows for s in sources))
        claims.write_whole(self.spark, f"{self.folder}/bases/{name}.json", {"name": name, "holds": sorted(versions)})
        return name
