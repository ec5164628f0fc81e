"""The scan: accounts, repositories, commits and trees to findings.

Input tables (any extra columns are ignored):

    accounts        account_id, account_ord, keywords
    repos           account_id, repo, repo_ord, fork, archived
    commits         repo, commit_sha, commit_ord           (commit_ord grows from newest to oldest)
    tree            commit_sha, path, blob_sha, size       (blobs only)
    blobs           blob_sha, text                         (one row per blob)
    image_metadata  blob_sha, meta_json                    (one row per blob)

A tree lists every file again for every commit, so content is scanned once per blob and the
findings, not the texts, are joined back to the files.  A file that stays the same over neighbouring commits is one
row with a bit per commit until its findings are known (``planned_blocks``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import action_for, is_image, is_scannable
from ..model import ScanOptions
from ..operators import images, keywords, names
from ..operators.lines import text_findings
from ..operators.rules import LINE_RULES
from ..operators.skew import FEW_ROWS, ROWS_PER_SALT, salted_join
from ..sources.files import free_shuffles, stage
from ..sources.records import filter_repos

IMAGE, TEXT = "image", "text"
FILE_COLUMNS = ["account_id", "account_ord", "repo", "repo_ord", "path", "blob_sha", "route", "block", "bits"]
SPREAD = ["repo", "block", "path"]
COMMIT_COLUMNS = ["repo", "commit_sha", "commit_ord", "account_id", "repo_ord", "account_ord"]


@dataclass(frozen=True)
class ScanTables:
    accounts: DataFrame
    repos: DataFrame
    commits: DataFrame
    tree: DataFrame
    blobs: DataFrame
    image_metadata: DataFrame
    #: Sketches of the tree's commits (``skew.key_sketches``), if they are kept beside it: then no scan counts the tree.
    tree_sketches: DataFrame | None = None


def route(path: Column, size: Column, options: ScanOptions = ScanOptions()) -> Column:
    """``image``, ``text`` or NULL for files that are not read."""
    return F.when(
        size <= options.max_file_bytes,
        F.when(is_image(path), F.lit(IMAGE)).when(
            is_scannable(path, options.strict_extensions), F.lit(TEXT)
        ),
    )


def selected_commits(
    t: ScanTables, options: ScanOptions = ScanOptions(), rows_per_salt: int = ROWS_PER_SALT,
    more_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Commits of the chosen accounts' repositories."""
    repos = filter_repos(t.repos, options).select("account_id", "repo", "repo_ord")
    owned = salted_join(
        repos, t.accounts.select("account_id", "account_ord"), ["account_id"], ["repo"], rows_per_salt, few_rows=FEW_ROWS
    )
    commits = t.commits.select("repo", "commit_sha", "commit_ord", *more_columns)
    return salted_join(commits, owned, ["repo"], ["commit_sha"], rows_per_salt)


def planned_files(
    t: ScanTables, options: ScanOptions = ScanOptions(), rows_per_salt: int = ROWS_PER_SALT,
    commits: DataFrame | None = None, more_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Every file to read, with its route; contents are not touched.

    ``commits`` are the selected commits, if they are known already.
    """
    files = t.tree.select(
        "commit_sha", "path", "blob_sha", route(F.col("path"), F.col("size"), options).alias("route")
    ).where(F.col("route").isNotNull())
    if commits is None:
        commits = selected_commits(t, options, rows_per_salt)
    commits = commits.select(*COMMIT_COLUMNS, *more_columns)
    return salted_join(files, commits, ["commit_sha"], ["path"], rows_per_salt, counted=t.tree, sketches=t.tree_sketches)


BLOCK = 64  # commits per row of a file


def numbered_commits(commits: DataFrame) -> DataFrame:
    """Commits with ``pos``, a number of their own that follows their order within a repository, staged.

    Sorted by ranges, so a repository with very many commits is spread over tasks; numbers need not be dense.
    """
    order = ["repo", "commit_ord", "commit_sha"]
    ranged = commits.select(*COMMIT_COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn("pos", F.monotonically_increasing_id()), "commits")


def planned_blocks(
    t: ScanTables, commits: DataFrame, options: ScanOptions = ScanOptions(), rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """The files to read, one row per ``BLOCK`` neighbouring commits in which a file is the same, staged.

    ``bits`` tells which commits of the block have it.  Rows are combined before they are shuffled, and a key
    has at most ``BLOCK`` rows.  A tree that lists a file of a commit twice keeps both, as a second row of the block; blocks
    with files listed more often than that stay single rows, for which the tree is read again.
    """
    files = _single_bits(planned_files(t, options, rows_per_salt, commits, ("pos",)))
    keys = [c for c in FILE_COLUMNS if c != "bits"]
    blocks = stage(
        files.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_xor("bits").alias("odd"), F.count(F.lit(1)).alias("n")), "files"
    )
    again = F.col("bits").bitwiseXOR(F.col("odd"))
    whole = F.bit_count("bits") + F.bit_count(again) == F.col("n")
    counted = blocks.where(whole).select(*keys, "bits").unionByName(blocks.where(whole & (again != 0)).select(*keys, again.alias("bits")))
    often = blocks.where(~whole).select(*keys)
    if often.isEmpty():
        return counted
    named = often.select("path", "blob_sha").distinct()
    listed = stage(t.tree.join(named, [t.tree[k].eqNullSafe(named[k]) for k in named.columns], "left_semi"), "listed-often")
    files = _single_bits(planned_files(replace(t, tree=listed, tree_sketches=None), options, rows_per_salt, commits, ("pos",)))
    return counted.unionByName(stage(files.join(often, [files[k].eqNullSafe(often[k]) for k in keys], "left_semi"), "files"))


def _single_bits(files: DataFrame) -> DataFrame:
    """Planned files with ``pos`` as rows of blocks with one bit each."""
    return files.select(
        *[c for c in FILE_COLUMNS if c not in ("block", "bits")], F.floor(F.col("pos") / BLOCK).alias("block"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % BLOCK).cast("int")).alias("bits"),
    )


def expand_blocks(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of blocks as rows of their commits, with ``commit_sha`` and ``commit_ord``.

    A number names one commit, so adaptive execution can split a commit of very many rows; counting keys
    here would work out all the findings twice.
    """
    places = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.getbit("bits", i) == 1)
    single = rows.select("*", F.explode(places).alias("place")).withColumn("pos", F.col("block") * BLOCK + F.col("place"))
    return single.drop("place", "bits", "block").join(commits.select("pos", "commit_sha", "commit_ord"), "pos").drop("pos")


def skipped_files(
    t: ScanTables, options: ScanOptions = ScanOptions(), rows_per_salt: int = ROWS_PER_SALT,
    commits: DataFrame | None = None,
) -> DataFrame:
    """Files of the chosen commits that are too large to be read."""
    large = t.tree.where(F.col("size") > options.max_file_bytes).select("commit_sha", "path", "size")
    if commits is None:
        commits = selected_commits(t, options, rows_per_salt)
    commits = commits.select(*COMMIT_COLUMNS)
    joined = salted_join(large, commits, ["commit_sha"], ["path"], rows_per_salt, counted=t.tree, sketches=t.tree_sketches)
    return joined.select("account_id", "repo", "commit_sha", "path", "size")


def blob_findings(t: ScanTables, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings that depend on a blob's content alone: one narrow pass over texts and records.

    Each readable text also gives one row without a rule: file names are judged only where the
    content could be read, and that row brings the news along in the same join.
    """
    key = ["blob_sha"]
    records = images.parse_metadata(t.image_metadata, key)
    return (
        text_findings(t.blobs, key, LINE_RULES)
        .withColumn("route", F.lit(TEXT))
        .unionByName(
            images.image_findings(records, key, options.store_exact_gps).withColumn("route", F.lit(IMAGE)),
            allowMissingColumns=True,
        )
    )


def with_name_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Turns each row without a rule into the file-name findings of its path, others stay.

    One explode in place, so that the join below runs once.
    """
    own = F.struct("rule", "severity", "redacted_evidence", "scanner_ord", "rule_ord")
    hits = F.when(F.col("rule").isNull(), names.name_hits(F.col("path"))).otherwise(F.array(own))
    return (
        rows.select(*keys, "line", "metadata", "match_ord", F.explode_outer(hits).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(*keys, "line", "metadata",
                "match_ord", "hit.*")
    )


def keyword_file_findings(
    t: ScanTables, files: DataFrame, file_columns: list[str], rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Keyword findings of text files: each (text, pattern) pair is matched once.

    Files with their patterns are staged, as two steps read them.  The distinct pairs say which texts meet which
    patterns; with many patterns an index gives the lines, so neither texts nor lists of patterns move.
    """
    texts = stage(
        salted_join(
            files.where(F.col("route") == TEXT), keywords.keyword_patterns(t.accounts), ["account_id"], SPREAD, rows_per_salt,
            counted=files, few_rows=FEW_ROWS,
        ),
        "keyword-files",
    )
    wanted = texts.select("blob_sha", "pattern").distinct()
    patterns = keywords.distinct_patterns(t.accounts)
    found = keywords.wanted_findings(t.blobs.select("blob_sha", "text"), wanted, patterns, "blob_sha")
    return salted_join(
        texts, found, ["blob_sha", "pattern"], SPREAD, rows_per_salt
    ).drop("pattern")


def scan(
    t: ScanTables, options: ScanOptions = ScanOptions(), rows_per_salt: int = ROWS_PER_SALT,
    restricted: bool = False, commits: DataFrame | None = None,
) -> DataFrame:
    """All findings with their order columns (``model.FINDING_COLUMNS`` + ``model.ORDER_COLUMNS``).

    The file plan is read by several joins, so it is written once to the shared folder.  A ``restricted`` scan
    (some accounts or repositories, or the commits of an incremental run) looks only at the blobs of planned
    files, others are skipped by a semi join; a full scan looks at them all and needs no such join.
    """
    if commits is None:
        commits = selected_commits(t, options, rows_per_salt)
    commits = numbered_commits(commits)
    files = planned_blocks(t, commits, options, rows_per_salt)
    free_shuffles(files.sparkSession)
    if restricted:
        needed = files.select("blob_sha").distinct()
        t = replace(
            t, blobs=t.blobs.join(needed, "blob_sha", "left_semi"),
            image_metadata=t.image_metadata.join(needed, "blob_sha", "left_semi"),
        )
    columns = [c for c in FILE_COLUMNS if c not in ("blob_sha", "route")]
    content = with_name_findings(
        salted_join(files, blob_findings(t, options), ["blob_sha", "route"], SPREAD, rows_per_salt), columns
    )
    custom = keyword_file_findings(t, files, columns, rows_per_salt)
    return as_findings(expand_blocks(content.unionByName(custom, allowMissingColumns=True), commits))


def as_findings(rows: DataFrame) -> DataFrame:
    """File and detector columns in the layout of the findings table."""
    return rows.select(
        F.col("account_id").alias("account"),
        "repo",
        F.col("path").alias("file"),
        "line",
        F.col("commit_sha").alias("commit"),
        "rule",
        "severity",
        "redacted_evidence",
        "metadata",
        action_for(F.col("rule")).alias("suggested_action"),
        "account_ord",
        "repo_ord",
        "commit_ord",
        "scanner_ord",
        F.coalesce("line", F.lit(0)).alias("line_ord"),
        "rule_ord",
        F.coalesce("match_ord", F.lit(0)).alias("match_ord"),
    )
