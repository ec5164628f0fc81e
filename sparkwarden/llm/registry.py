"""The registered queries of this subpackage and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_table
from . import pieces, quality, toxicity
from .fm_index import contamination
from .lm_scores import cross_entropy_difference
from .merkle import folded, manifest, proof, row_digest
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .secret_spans import KINDS, find_secrets, joined
from .staging import one_text_per_id
from .suffix_dedup import remove_repeats
from .vector_dedup import near_duplicate_vectors
from .whitening import whiten


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the same rows as op1; the others show held-out accuracy."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    known = labels.where(~_held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.classify(docs, known).withColumn("held_out", _held_out())


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text, 256).alias("sha256"))
    done = pieces.decode(pieces.encode(docs, path, "sha256"), path)
    decoded = F.sha2("decoded", 256)
    return done.select(
        "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), decoded.alias("decoded_sha256"), (decoded == F.col("sha256")).alias("round_trip")
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the text of the benchmark, the background all documents."""
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(kind) for kind in KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lost = remove_repeats(docs).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("rest"))
    whole = one_text_per_id(docs).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("all")
    )
    zero = F.lit(0).cast("long")
    return whole.join(lost, "doc_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("rest", "all").alias("kept_sha256"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.withColumnRenamed("id", "vec_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=4).withColumnRenamed("id", "vec_id")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select(
        "doc_id", "source", row_digest(*rest, F.col("text")).alias("leaf"),
        F.when(tampered, row_digest(*rest, F.translate("text", upper, upper.lower()))).alias("tampered"),
    )
    tree = manifest(leaves, group="source", order="doc_id", leaf="leaf")
    root = F.lit(tree.root).cast("string")
    return tree.leaves.select(
        "doc_id", "leaf", F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"), proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_cotraining": op2_quality_cotraining,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_lm_scores": op4_lm_scores,
    "op5_secret_scan": op5_secret_scan,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_vector_near_dedup": op10_vector_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}



def _secrets_sql() -> str:
    """Spans by splitting at the matches; each window's entropy worked out on its own.  All rules are written out here anew."""
    width = 20
    cut = "(?i:example|sample|dummy|placeholder|xxxx|abcdefgh|01234567|12345678)|[0-9]{4}-[0-9]{2}-[0-9]{2}"
    uuid = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    word = "([A-Z][a-z]{1,13}|[a-z]{1,14}|[A-Z]{1,14})"
    words = f"^[-_/]*({word}[-_/]+)*{word}?[-_/]*[0-9]{{0,4}}$"
    name = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = name + """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {"assign": (assign, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24), "entropy": ("[A-Za-z0-9+/=_-]+", 0, width)}
    parts = []
    for nth, (kind, (pattern, group, least)) in enumerate(patterns.items()):
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
            select doc_id, '{kind}' as kind, {nth} as nth, m[i] as found, length(v[i]) >= {least} as long,
                   cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as start
            from (select doc_id, regexp_extract_all(t, {quoted}, 0) as m, regexp_extract_all(t, {quoted}, {group}) as v, string_split_regex(t, {quoted}) as g from d),
                 lateral (select unnest(range(1, len(m) + 1)) as i)""")
    return f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        every as ({" union all ".join(parts)}),
        base as (select doc_id, kind, nth, start, start + length(found) as stop from every where long and kind <> 'entropy'),
        cut as (select doc_id, start, regexp_extract_all(found, '{cut}', 0) as m, string_split_regex(found, '{cut}') as g from every where long and kind = 'entropy'),
        pieces as (
            select doc_id, g[i] as piece,
                   start + cast(coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as start
            from cut, lateral (select unnest(range(1, len(g) + 1)) as i)),
        windows as (
            select doc_id, start, unnest(list_filter(range(0, length(piece) - {width} + 1),
                lambda i: list_entropy(string_split(piece[i + 1:i + {width}], '')) >
                          case when regexp_matches(piece, '^[0-9a-fA-F]+$') then 3.05 when regexp_matches(piece, '^[A-Za-z0-9]+$') then 3.75 else 3.85 end)) as w
            from pieces
            where length(piece) >= {width} and regexp_matches(piece, '[A-Za-z]') and not regexp_matches(piece, '{uuid}') and not regexp_matches(piece, '{words}')),
        high as (select doc_id, 'entropy' as kind, 3 as nth, start + min(w) as b, start + max(w) + {width} as stop from windows group by doc_id, start),
        spans as (select * from base union all select doc_id, kind, nth, b, stop from high),
        told as (
            select doc_id,
                   count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
                   count(*) filter (where kind = 'hex') as n_hex,
                   coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, nth) filter (where nth < 3), '') as base,
                   string_agg(kind || ':' || start || ':' || stop, ',' order by start, nth) as spans
            from spans group by doc_id)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join told using (doc_id)"""


_DECONTAMINATION_SQL = r"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, row_number() over () as r from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
    windows as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as gram
                from b, lateral (select unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) as i)),
    sizes as (select distinct n from windows),
    places as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as gram
               from d, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i)),
    found as (select r, i, n, item_id from places join windows using (n, gram)),
    words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from found)) group by r),
    items as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, item_id::varchar as id from found) group by r)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 as contaminated
    from d left join words using (r) left join items using (r)"""


def _merkle_sql(levels: int = 5) -> str:
    """Runs of each level as lists; sources of up to 16**levels rows, and as many sources."""
    fields = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c & 255, b), range(0, 8)), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end))))"""
    parts = [f"""d as (
            select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n,
                   dense_rank() over (order by source nulls first) - 1 as g
            from (select doc_id, source, sha256({fields} || coalesce(strlen(text) || ':' || text, '-')) as leaf,
                         case when doc_id is not null and {crc} % 5 = 0 then sha256({fields} || coalesce(strlen({lower}) || ':' || {lower}, '-')) end as tampered
                  from documents)),
        s0 as (select g, place, n, leaf as digest from d)"""]

    def tree(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}run{k} as (select g, place // 16 as place, any_value(n) as n, list(digest order by place) as run from {name}{k} group by all),
        {name}{k + 1} as (select g, place, (n + 15) // 16 as n, case when n = 1 then run[1] else sha256(array_to_string(run, '')) end as digest from {name}run{k})""")

    tree("s")
    parts.append(f"t0 as (select 0 as g, g as place, count(*) over () as n, digest from s{levels})")
    tree("t")

    def fold(source: str, name: str, place: str, group: str, k: int) -> str:
        slot = f"({place} // {16 ** k} % 16)"
        alone, left, right = "n = 1", f"array_to_string(run[1:{slot}], '')", f"array_to_string(run[{slot} + 2:], '')"
        return f"""select {source}.* exclude (siblings, folded), siblings || case when {alone} then '' else {left} || {right} end as siblings,
            case when {alone} then folded else sha256({left} || folded || {right}) end as folded
            from {source} join (select g as rg, place as ra, n, run from {name}run{k}) on rg = {group} and ra = {place} // {16 ** (k + 1)}"""

    parts.append("f0 as (select doc_id, leaf, g as dg, place as dat, '' as siblings, coalesce(tampered, leaf) as folded from d)")
    for k in range(levels):
        parts.append(f"f{k + 1} as ({fold(f'f{k}', 's', 'dat', 'dg', k)})")
    for k in range(levels):
        parts.append(f"f{levels + k + 1} as ({fold(f'f{levels + k}', 't', 'dg', '0', k)})")
    return f"""with {", ".join(parts)}
        select doc_id, leaf, s.digest as subroot, r.digest as root, sha256(siblings) as proof_sha256, folded as folded_root, folded = r.digest as verified
        from f{2 * levels} join s{levels} s on s.g = dg cross join t{levels} r"""


SQL: dict[str, str] = {"op5_secret_scan": _secrets_sql(), "op12_decontamination": _DECONTAMINATION_SQL, "op13_merkle_manifest": _merkle_sql()}
