"""Named queries over the test tables, one or more per operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions import redact, text as tx
from ..model import FINDING_COLUMNS, ORDER_COLUMNS, ScanOptions
from ..operators import images, keywords, logs, names
from ..operators.lines import (
    document_lines, line_findings, redacted, redacted_text, rule_name, rule_severity, scan_lines, spread,
)
from ..operators.rules import LINE_RULES, PII_RULES, SECRET_RULES, is_pii_false_positive, rules_named
from ..operators.skew import key_sketches, running_totals, salted_join
from ..plans import incremental as inc
from ..plans import report as rep
from ..plans import scan as sc
from ..sources import records as rec
from ..sources.files import read_named_text_files, read_table, shared_folder, stage, stage_result, write_text_files
from ..streaming import queries as st
from .inputs import load

Query = Callable[[SparkSession, str], DataFrame]
RUN = rep.RunInfo("2024-06-01T06:00:00.000Z", 0, 0, 0)
SEEN_AT = "2024-06-01T06:00:00Z"
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Scalars only: integers as BIGINT, arrays and maps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ByteType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.array_sort(c), ",")
        elif isinstance(f.dataType, T.MapType):
            pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
            c = F.array_join(pairs, ", ")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- inputs
# derived inputs that stand for big source tables, with the columns that spread their rows
SOURCE_TABLES = {
    "doc_files": ["doc_id"],
    "chat_files": ["conv_id", "turn"],
    "image_files": ["p_partkey"],
    "image_metadata": ["blob_sha"],
}
# big base tables of short rows, whose derived rows are longer than their own: nothing derived is moved or written
NARROW_TABLES = {
    "lineitem": ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
}
_sources: dict[tuple, DataFrame] = {}
_folders: dict[tuple, str] = {}


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the folder's files: changed files are read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def _narrow(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = read_table(spark, folder, name)
    return spread(table.select(*NARROW_TABLES[name]), *NARROW_TABLES[name][:2]) if name in NARROW_TABLES else table


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table: derived from the test tables, and written once per session if its rows are long."""
    if name not in SOURCE_TABLES:
        return load(spark, folder, name, _narrow)
    key = (spark.sparkContext.applicationId, folder, name, _state(spark, folder))
    if key not in _sources:
        _sources[key] = stage(spread(load(spark, folder, name), *SOURCE_TABLES[name]), name)
    return _sources[key]


def tree_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of the tree's commits, written once beside the tree."""
    key = (spark.sparkContext.applicationId, folder, "tree_sketches", _state(spark, folder))
    if key not in _sources:
        tree = rec.shape_tree(source(spark, folder, "raw_tree"))
        _sources[key] = stage(key_sketches(tree, ["commit_sha"]), "tree_sketches")
    return _sources[key]


def doc_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return source(spark, folder, "doc_files").select(*columns, "text")


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    raw = load(spark, folder, "raw_accounts").withColumn("keywords", F.split("keyword_list", ","))
    return rec.normalize_accounts(raw.drop("keyword_list"))


def scanned_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return rec.enabled_accounts(accounts(spark, folder))


def raw_commits(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commit records: author date, committer date and author name go missing in turn."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date").cast("string")
    return load(spark, folder, "orders").select(
        F.md5(key.cast("string")).alias("sha"),
        F.struct(
            F.concat(F.lit("order "), key.cast("string"), F.lit(" "), "o_orderpriority").alias("message"),
            F.struct(
                F.when(key % 3 != 0, F.concat(F.lit("author "), (key % 50).cast("string"))).alias("name"),
                F.when(key % 4 != 0, day).alias("date"),
            ).alias("author"),
            F.struct(F.when(key % 8 != 0, F.concat(day, F.lit("c"))).alias("date")).alias("committer"),
        ).alias("commit"),
        F.struct(F.when(key % 9 != 0, F.concat(F.lit("login"), (key % 50).cast("string"))).alias("login")).alias(
            "author"),
    )


def raw_gists(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    files = F.when(
        key % 3 == 0, F.create_map(F.lit("a.txt"), F.col("c_name"), F.lit("b.md"), F.lit(""))
    ).when(key % 3 == 1, F.create_map(F.lit("notes.md"), F.col("c_mktsegment")))
    return load(spark, folder, "customer").select(
        F.when(key % 29 != 0, F.concat(F.lit("g"), key.cast("string"))).alias("id"),
        F.col("c_mktsegment").alias("description"),
        F.when(key % 4 != 0, key % 2 == 0).alias("public"),
        F.when(key % 5 != 0, F.lit("2024-01-01T00:00:00Z")).alias("updated_at"),
        files.alias("files"),
    )


def raw_releases(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    asset = lambda i: F.struct(
        (key * 10 + i).alias("id"),
        F.concat(F.lit(f"asset{i}-"), "o_orderpriority").alias("name"),
        F.concat(F.lit("https://files.example.org/"), key.cast("string"), F.lit(f"/{i}")).alias(
            "browser_download_url"),
    )
    assets = F.when(key % 4 == 1, F.array().cast("array<struct<id:bigint,name:string,browser_download_url:string>>"))
    assets = assets.when(key % 4 == 2, F.array(asset(0))).when(key % 4 == 3, F.array(asset(0), asset(1)))
    return load(spark, folder, "orders").select(
        F.concat(F.lit("repo_"), F.col("o_custkey").cast("string")).alias("repo"), assets.alias("assets"))


def raw_content(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as content records: plain, base64, other encodings and missing content."""
    key = F.col("doc_id")
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(
        "doc_id",
        F.when(key % 4 == 1, "base64").when(key % 4 == 2, "none").alias("encoding"),
        F.when(key % 4 == 1, F.base64(F.encode("text", "UTF-8"))).when(key % 8 != 3, F.col("text")).alias("content"),
    )


def scan_tables(spark: SparkSession, folder: str, account_table: DataFrame | None = None) -> sc.ScanTables:
    return sc.ScanTables(
        accounts=account_table or scanned_accounts(spark, folder),
        repos=load(spark, folder, "repos"),
        commits=source(spark, folder, "commits"),
        tree=rec.shape_tree(source(spark, folder, "raw_tree")),
        blobs=doc_files(spark, folder, "blob_sha"),
        image_metadata=source(spark, folder, "image_metadata"),
        tree_sketches=tree_sketches(spark, folder),
    )


_runs: dict[tuple, DataFrame] = {}


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings table of one run: written once per session, read by all reports."""
    key = (spark.sparkContext.applicationId, folder, _state(spark, folder))
    if key not in _runs:
        tables = scan_tables(spark, folder)
        _runs[key] = stage_result(spark, lambda: sc.scan(tables), "findings")
    return _runs[key]


def scanned_repos(spark: SparkSession, folder: str) -> DataFrame:
    return rec.filter_repos(load(spark, folder, "repos")).join(
        scanned_accounts(spark, folder).select("account_id"), "account_id")


def scanned_commits(spark: SparkSession, folder: str) -> DataFrame:
    return sc.selected_commits(scan_tables(spark, folder))


def run_info(spark: SparkSession, folder: str) -> rep.RunInfo:
    """Three counters of the run."""
    totals = rep.run_totals(
        scanned_accounts(spark, folder), scanned_repos(spark, folder), scanned_commits(spark, folder),
        findings(spark, folder),
    )
    n = {r.metric: r.n for r in totals.collect()}
    return rep.RunInfo(RUN.finished_at, n["accounts"], n["repos"], n["commits"])


# ---------------------------------------------------------------- sources and record shaping
@query
def accounts_normalized(spark, folder):
    return flat(accounts(spark, folder))


@query
def repos_shaped(spark, folder):
    return flat(rec.shape_repos(load(spark, folder, "raw_repos")))


@query
def commits_shaped(spark, folder):
    return flat(rec.shape_commits(raw_commits(spark, folder)))


@query
def tree_blobs(spark, folder):
    return flat(rec.shape_tree(source(spark, folder, "raw_tree")))


@query
def content_decoded(spark, folder):
    text = rec.decode_content(raw_content(spark, folder))
    return text.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query
def gists_shaped(spark, folder):
    return flat(rec.shape_gists(raw_gists(spark, folder)))


@query
def gist_files(spark, folder):
    return flat(rec.gist_files(raw_gists(spark, folder)))


@query
def release_assets_flat(spark, folder):
    return flat(rec.release_assets(raw_releases(spark, folder)))


@query
def files_source(spark, folder):
    """The texts as one file each, read back as a folder of files."""
    key = (spark.sparkContext.applicationId, folder, "files", _state(spark, folder))
    if key not in _folders:
        texts = doc_files(spark, folder, "doc_id", "path")
        _folders[key] = write_text_files(texts, shared_folder(spark, "files"), "doc_id", "path")
    files = read_named_text_files(spark, _folders[key], "doc_id long, path string")
    return flat(files.select("doc_id", "path", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")))


# ---------------------------------------------------------------- filters and routing
@query
def accounts_enabled(spark, folder):
    return scanned_accounts(spark, folder).select("account_id", "user")


@query
def account_by_id(spark, folder):
    return flat(rec.account_by_id(accounts(spark, folder), "acct_4").select("account_id", "user", "enabled"))


@query
def repos_filtered(spark, folder):
    repos = rec.filter_repos(rec.shape_repos(load(spark, folder, "raw_repos")))
    return repos.select("c_custkey", "repo", "pushed_at").orderBy(F.col("pushed_at").desc(), "c_custkey")


@query
def files_size_ok(spark, folder):
    tree = rec.shape_tree(source(spark, folder, "raw_tree"))
    return tree.where(F.col("size") <= ScanOptions().max_file_bytes).select("commit_sha", "path", "blob_sha", "size")


def _routes(spark, folder, options):
    tree = rec.shape_tree(source(spark, folder, "raw_tree"))
    return tree.select("commit_sha", "path", F.coalesce(sc.route(F.col("path"), F.col("size"), options),
                                                        F.lit("skip")).alias("route"))


@query
def route_files(spark, folder):
    return _routes(spark, folder, ScanOptions())


@query
def route_files_strict(spark, folder):
    return _routes(spark, folder, ScanOptions(strict_extensions=True))


@query
def file_basenames(spark, folder):
    tree = source(spark, folder, "raw_tree").select("commit_sha", "path")
    slashed = tree.select("commit_sha", F.explode(F.array("path", F.replace("path", F.lit("/"), F.lit("\\")),
                                                          F.concat("path", F.lit("/")))).alias("path"))
    return slashed.select("commit_sha", "path", tx.base_name(F.col("path")).alias("base"))


@query
def pii_false_positives(spark, folder):
    found = scan_lines(doc_files(spark, folder, "doc_id"), ["doc_id"], PII_RULES, drop_false_positives=False)
    return flat(found.select("doc_id", "line", rule_name(F.col("rule_ord"), PII_RULES).alias("rule"), "match",
                             is_pii_false_positive(F.col("match")).alias("dropped")))


# ---------------------------------------------------------------- personal information
def _rule_query(name: str, rule: str) -> None:
    rules = rules_named(rule)

    def run(spark, folder):
        found = scan_lines(doc_files(spark, folder, "doc_id"), ["doc_id"], rules)
        return flat(found.select("doc_id", "line", "match_ord", "match",
                                 redacted(F.col("rule_ord"), F.col("match"), rules).alias("redacted_evidence")))

    REGISTRY[name] = run


for _name, _rule in {
    "pii_email": "email-address",
    "pii_uk_phone": "uk-phone",
    "pii_us_phone": "us-phone",
    "pii_uk_postcode": "uk-postcode",
    "pii_discord_invite": "discord-handle",
    "pii_discord_user": "discord-username",
    "pii_ipv4": "ipv4-address",
    "secret_google_api_key": "google-api-key",
    "secret_aws_access_key": "aws-access-key",
    "secret_aws_secret_key": "aws-secret-key",
    "secret_private_key_block": "private-key-block",
    "secret_env_value": "env-secret-value",
    "secret_database_url": "database-url",
    "secret_discord_webhook": "discord-webhook",
    "secret_github_token": "github-token",
    "secret_openai_key": "openai-key",
    "secret_sk_ant_key": "anthropic-key",
    "secret_azure_key": "azure-key",
    "secret_gcp_service_account": "gcp-service-account",
    "secret_bearer_token": "bearer-token",
    "secret_high_entropy": "high-entropy-string",
}.items():
    _rule_query(_name, _rule)


@query
def doc_lines(spark, folder):
    lines = document_lines(doc_files(spark, folder, "doc_id"), ["doc_id"])
    return flat(lines.select("doc_id", "line", F.md5("content").alias("line_md5")))


def _matches(spark, folder, rules):
    found = scan_lines(doc_files(spark, folder, "doc_id"), ["doc_id"], rules)
    ord_ = F.col("rule_ord")
    return found.select("doc_id", "line", rule_name(ord_, rules).alias("rule"),
                        rule_severity(ord_, rules).alias("severity"), "match_ord", "match",
                        redacted(ord_, F.col("match"), rules).alias("redacted_evidence"))


@query
def pii_matches(spark, folder):
    return flat(_matches(spark, folder, PII_RULES).drop("redacted_evidence"))


@query
def pii_redacted(spark, folder):
    return flat(_matches(spark, folder, PII_RULES).select("doc_id", "line", "rule", "redacted_evidence"))


_FILE = ["account_id", "repo", "path", "commit_sha"]


def _file_findings(found: DataFrame) -> DataFrame:
    for c in ("account_ord", "repo_ord", "commit_ord"):
        found = found.withColumn(c, F.lit(0))
    for c, kind in (("line", "int"), ("metadata", "map<string,string>"), ("match_ord", "int")):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast(kind))
    return flat(sc.as_findings(found).select(*FINDING_COLUMNS).drop("metadata"))


@query
def pii_findings(spark, folder):
    files = doc_files(spark, folder, *_FILE)
    found = line_findings(files, _FILE, PII_RULES)
    suspicious = names.suspicious_names(source(spark, folder, "doc_files").select(*_FILE), _FILE)
    return _file_findings(found.unionByName(suspicious, allowMissingColumns=True))


@query
def suspicious_filenames(spark, folder):
    found = names.suspicious_names(_tree_paths(spark, folder), ["commit_sha", "path"])
    return found.select("commit_sha", "path", "rule", "severity", "redacted_evidence")


# ---------------------------------------------------------------- secrets
@query
def secret_redacted(spark, folder):
    return flat(_matches(spark, folder, SECRET_RULES).select("doc_id", "line", "rule", "redacted_evidence"))


@query
def token_entropy(spark, folder):
    docs = doc_files(spark, folder, "doc_id")
    lines = document_lines(docs, ["doc_id"]).where(F.length("content") > 0)
    return flat(lines.select("doc_id", "line", redact.entropy(F.col("content")).alias("entropy")))


@query
def secret_findings(spark, folder):
    return _file_findings(line_findings(doc_files(spark, folder, *_FILE), _FILE, SECRET_RULES))


# ---------------------------------------------------------------- privacy risks
def _tree_paths(spark, folder):
    return source(spark, folder, "raw_tree").select("commit_sha", "path")


def _tree_names(spark, folder):
    return names.risk_names(_tree_paths(spark, folder), ["commit_sha", "path"])


@query
def filename_risk(spark, folder):
    return _tree_names(spark, folder).select("commit_sha", "path", "rule", "severity", "redacted_evidence")


@query
def filename_risk_by_rule(spark, folder):
    """Patterns look at each base name once: a tree repeats its files from commit to commit."""
    base = _tree_paths(spark, folder).groupBy(tx.base_name(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return names.risk_names(base, ["n"]).groupBy("rule", "severity").agg(F.sum("n").alias("n"))


@query
def log_line_counts(spark, folder):
    return flat(logs.log_line_counts(doc_files(spark, folder, "doc_id"), ["doc_id"]))


@query
def large_log_files(spark, folder):
    return flat(logs.large_logs(doc_files(spark, folder, "doc_id"), ["doc_id"]))


@query
def privacy_risk_findings(spark, folder):
    files = source(spark, folder, "doc_files")
    found = names.risk_names(files.select(*_FILE), _FILE).unionByName(
        logs.log_findings(doc_files(spark, folder, *_FILE), _FILE))
    return _file_findings(found)


# ---------------------------------------------------------------- keywords
@query
def keyword_patterns(spark, folder):
    return keywords.keyword_patterns(accounts(spark, folder))


def _wanted_texts(spark, folder):
    """Texts by blob, the (text, pattern) pairs that their accounts want, and the patterns; only ids are joined."""
    listed = accounts(spark, folder)
    files = source(spark, folder, "doc_files")
    owned = files.select("account_id", "blob_sha")
    wanted = salted_join(owned, keywords.keyword_patterns(listed), ["account_id"], ["blob_sha"]).select("blob_sha", "pattern")
    return files.select("blob_sha", "text"), wanted, keywords.distinct_patterns(listed), "blob_sha"


def _file_columns(spark, folder, found, *columns):
    """Findings of blobs as findings of their files."""
    files = source(spark, folder, "doc_files").select("blob_sha", *columns)
    return found.join(files, "blob_sha")


@query
def keyword_matches(spark, folder):
    found = keywords.wanted_matches(*_wanted_texts(spark, folder))
    return flat(_file_columns(spark, folder, found, "doc_id").select("doc_id", "line", "match_ord", "match"))


@query
def keyword_severity(spark, folder):
    found = keywords.wanted_matches(*_wanted_texts(spark, folder))
    return found.groupBy(F.lower("match").alias("keyword")).agg(
        F.max(keywords.keyword_severity(F.col("match"))).alias("severity"), F.count(F.lit(1)).alias("n"))


@query
def keyword_findings(spark, folder):
    found = keywords.wanted_findings(*_wanted_texts(spark, folder))
    return _file_findings(_file_columns(spark, folder, found, *_FILE).drop("blob_sha", "pattern"))


# ---------------------------------------------------------------- image metadata
def _parsed_images(spark, folder):
    return images.parse_metadata(source(spark, folder, "image_files"), ["p_partkey", "path"])


@query
def exif_parsed(spark, folder):
    return flat(_parsed_images(spark, folder).drop("path"))


@query
def exif_gps(spark, folder):
    return flat(_parsed_images(spark, folder).where("has_gps").select("p_partkey", "gps_lat", "gps_lng"))


def _image_findings(spark, folder, exact):
    found = images.image_findings(_parsed_images(spark, folder), ["p_partkey", "path"], exact)
    return flat(found.select("p_partkey", "path", "rule", "severity", "redacted_evidence", "metadata"))


@query
def exif_findings(spark, folder):
    return _image_findings(spark, folder, False)


@query
def exif_findings_exact(spark, folder):
    return _image_findings(spark, folder, True)


# ---------------------------------------------------------------- the scan
@query
def scan_plan(spark, folder):
    files = sc.planned_files(scan_tables(spark, folder))
    return flat(files.select("account_id", "repo", "commit_sha", "path", "blob_sha", "route"))


@query
def all_findings(spark, folder):
    return flat(findings(spark, folder).select(*FINDING_COLUMNS))


@query
def account_findings(spark, folder):
    """A scan of one account, which need not be enabled."""
    one = rec.account_by_id(accounts(spark, folder), "acct_4")
    return flat(sc.scan(scan_tables(spark, folder, one), restricted=True).select(*FINDING_COLUMNS))


# ---------------------------------------------------------------- counts and order
@query
def severity_counts(spark, folder):
    return flat(rep.severity_counts(findings(spark, folder)))


@query
def run_totals(spark, folder):
    return rep.run_totals(scanned_accounts(spark, folder), scanned_repos(spark, folder),
                          scanned_commits(spark, folder), findings(spark, folder))


@query
def findings_by_repo(spark, folder):
    return flat(rep.findings_by_repo(findings(spark, folder)))


@query
def findings_rollup(spark, folder):
    return flat(rep.counts_by_account(findings(spark, folder)))


@query
def findings_cube(spark, folder):
    return flat(rep.findings_cube(findings(spark, folder)))


_KEYS = ["severity", *ORDER_COLUMNS, "rule", "line"]


@query
def unique_findings(spark, folder):
    return flat(rep.unique_findings(findings(spark, folder).select(*_KEYS, "redacted_evidence")))


@query
def findings_sorted(spark, folder):
    return flat(rep.sorted_findings(findings(spark, folder)).select("severity_rank", *_KEYS))


# ---------------------------------------------------------------- state
@query
def incremental_commits(spark, folder):
    return inc.new_commits(source(spark, folder, "commits"), load(spark, folder, "scanned")).select(
        "account_id", "repo", "commit_sha", "date")


@query
def incremental_commits_full(spark, folder):
    return inc.new_commits(source(spark, folder, "commits"), load(spark, folder, "scanned"), full=True).select(
        "account_id", "repo", "commit_sha", "date")


def _next_cursors(spark, folder):
    fresh = inc.new_commits(source(spark, folder, "commits"), load(spark, folder, "scanned"))
    return inc.next_cursors(fresh, load(spark, folder, "cursors"), SEEN_AT)


@query
def next_cursor(spark, folder):
    return _next_cursors(spark, folder)


@query
def cursor_upsert(spark, folder):
    return inc.upsert(load(spark, folder, "cursors"), _next_cursors(spark, folder), ["account_id", "repo"])


@query
def unseen_gists(spark, folder):
    listed = load(spark, folder, "gists").select("account_id", "gist_id").distinct()
    return inc.unseen(listed, load(spark, folder, "seen_gists"), ["account_id", "gist_id"])


@query
def gists_marked_seen(spark, folder):
    return inc.mark_gists_seen(load(spark, folder, "seen_gists"), load(spark, folder, "gists"), SEEN_AT)


@query
def unseen_assets(spark, folder):
    return inc.unseen(load(spark, folder, "assets"), load(spark, folder, "seen_assets"), ["account_id", "asset_id"])


@query
def assets_marked_seen(spark, folder):
    return inc.mark_assets_seen(load(spark, folder, "seen_assets"), load(spark, folder, "assets"), SEEN_AT)


@query
def last_run(spark, folder):
    return flat(inc.last_run(load(spark, folder, "runs")))


@query
def last_finished_run(spark, folder):
    return flat(inc.last_finished_run(load(spark, folder, "runs")))


@query
def run_ledger(spark, folder):
    found = findings(spark, folder).select(F.col("account").alias("account_id"))
    last = inc.last_run(load(spark, folder, "runs")).first()
    return flat(inc.ledger_rows(
        scanned_accounts(spark, folder), scanned_repos(spark, folder), scanned_commits(spark, folder), found,
        last.run_id if last else 0, SEEN_AT, RUN.finished_at))


@query
def ledger_running_totals(spark, folder):
    """Running findings count per account over its runs."""
    runs = load(spark, folder, "runs").select("account_id", "run_id", "findings_count")
    return running_totals(runs, ["account_id"], "run_id", {"findings_count": "findings_so_far"}, block=1_024)


# ---------------------------------------------------------------- reports
@query
def finding_blocks(spark, folder):
    return flat(rep.finding_blocks(findings(spark, folder)))


@query
def report_summary(spark, folder):
    return rep.summaries(findings(spark, folder), run_info(spark, folder)).where(F.col("account").isNull()).select(
        "text")


@query
def fix_list(spark, folder):
    return flat(rep.fix_list(findings(spark, folder)))


@query
def account_reports(spark, folder):
    rows = rep.account_reports(findings(spark, folder), run_info(spark, folder))
    return flat(rows.select(*rep.REPORT_ORDER, "text"))


@query
def report_summaries(spark, folder):
    reports = spread(load(spark, folder, "report_texts"), "doc_id")
    return reports.select("doc_id", rep.summary_of(F.col("report")).alias("summary"))


@query
def latest_report(spark, folder):
    return rep.latest_report(load(spark, folder, "report_files"))


@query
def digest(spark, folder):
    """One message per account, as the rows of its text."""
    return flat(rep.digests(scanned_accounts(spark, folder), findings(spark, folder), run_info(spark, folder)))


@query
def run_report(spark, folder):
    rows = rep.run_report(findings(spark, folder), run_info(spark, folder))
    return flat(rows.select(*rep.RUN_ORDER, "text"))


# ---------------------------------------------------------------- the detectors on other tables
def _by(spark, folder, column):
    docs = spread(load(spark, folder, "documents").select("doc_id", column, "text"), "doc_id")
    found = line_findings(docs, [column], PII_RULES)
    return found.groupBy(column, "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def pii_by_source(spark, folder):
    return _by(spark, folder, "source")


@query
def pii_by_lang(spark, folder):
    return _by(spark, folder, "lang")


@query
def conversation_findings(spark, folder):
    chats = source(spark, folder, "chat_files")
    return line_findings(chats, ["role"], LINE_RULES).groupBy("role", "rule", "severity").agg(
        F.count(F.lit(1)).alias("n"))


@query
def page_findings(spark, folder):
    pages = spread(load(spark, folder, "pages"), "page_id").select(
        F.regexp_extract("url", r"^https?://([^/:?#]*)", 1).alias("host"), "html")
    return line_findings(pages, ["host"], LINE_RULES, text="html").groupBy("host", "rule", "severity").agg(
        F.count(F.lit(1)).alias("n"))


@query
def pii_rate_by_quality(spark, folder):
    """Labelled documents with and without a finding; texts stay where they are, only ids are joined."""
    found = line_findings(load(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], PII_RULES)
    labelled = load(spark, folder, "labels").join(load(spark, folder, "documents").select("doc_id"), "doc_id")
    marked = labelled.join(found.select("doc_id").distinct().withColumn("found", F.lit(1)), "doc_id", "left")
    n, n_found = F.count(F.lit(1)), F.count("found")
    return flat(marked.groupBy("quality", "toxic").agg(
        n.alias("n"), n_found.alias("n_found"), F.round(n_found / n, 6).alias("share")))


@query
def documents_redacted(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    done = docs.select("doc_id", redacted_text(F.col("text"), PII_RULES).alias("redacted"), "text")
    return done.select("doc_id", F.md5("redacted").alias("text_md5"), (F.col("redacted") != F.col("text")).alias("changed"))


# ---------------------------------------------------------------- streams
@query
def stream_findings(spark, folder):
    return flat(st.scanned_documents(spark, folder))


@query
def stream_unique_findings(spark, folder):
    return flat(st.unique_event_findings(spark, folder))


@query
def stream_severity_counts(spark, folder):
    return flat(st.windowed_severity_counts(spark, folder))


@query
def stream_unseen_gists(spark, folder):
    return flat(st.unseen_gists(spark, folder))


@query
def stream_run_ledger(spark, folder):
    return flat(st.run_ledger(spark, folder))


@query
def stream_ledger_totals(spark, folder):
    return flat(st.ledger_totals(spark, folder))


@query
def stream_assets_marked_seen(spark, folder):
    return flat(st.assets_marked_seen(spark, folder))


@query
def stream_first_findings(spark, folder):
    return flat(st.first_findings(spark, folder))
