"""State between runs as keyed tables: cursors, seen sets and the run ledger.

Every function takes the old table and returns the new one; ``write_version`` stores it next to the
old version, never over it; a version is overwritten only by the run that owns its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import running_totals


SCANNED_KEY = ["account_id", "repo", "commit_sha"]


def new_commits(commits: DataFrame, scanned: DataFrame, full: bool = False) -> DataFrame:
    """Commits that no run has scanned; all of them for a full run.

    Both tables have account_id, repo, commit_sha.  Dates play no part: a commit that arrives late with an old
    date, or without one, is as new as any other.  The key is unique, so nothing is skewed.
    """
    return commits if full else commits.join(scanned.select(*SCANNED_KEY), SCANNED_KEY, "left_anti")


def next_cursors(commits: DataFrame, cursors: DataFrame, scanned_at: str) -> DataFrame:
    """Newest commit ever scanned of each repository that had commits; a late commit moves no cursor back."""
    repos = commits.select("account_id", "repo").distinct()
    before = cursors.join(repos, ["account_id", "repo"], "left_semi").select(
        "account_id", "repo", F.col("last_scanned_date").alias("date"), F.col("last_scanned_sha").alias("commit_sha")
    )
    return (
        commits.select(*before.columns).unionByName(before).groupBy("account_id", "repo")
        .agg(F.max(F.struct("date", "commit_sha")).alias("newest"))
        .select(
            "account_id",
            "repo",
            F.col("newest.commit_sha").alias("last_scanned_sha"),
            F.col("newest.date").alias("last_scanned_date"),
            F.lit(scanned_at).alias("last_scanned_at"),
        )
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old rows of the same key, except in ``keep_old`` columns.

    Both sides have one row per key, so one join does it.
    """
    o, n = old.alias("o"), new.withColumn("is_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    values = []
    for c in old.columns:
        if c in keys:
            values.append(F.col(c))
        elif c in keep_old:
            values.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            values.append(F.when(F.col("n.is_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*values)


def unseen(listed: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return listed.join(seen.select(*keys), keys, "left_anti")


def mark_gists_seen(seen: DataFrame, listed: DataFrame, seen_at: str) -> DataFrame:
    new = listed.select("account_id", "gist_id").distinct().withColumn("seen_at", F.lit(seen_at))
    return upsert(seen, new, ["account_id", "gist_id"])


def mark_assets_seen(seen: DataFrame, listed: DataFrame, seen_at: str) -> DataFrame:
    """An asset met again gets a new ``seen_at`` and keeps its first repository."""
    new = (
        listed.groupBy("account_id", "asset_id")
        .agg(F.min("repo").alias("repo"))
        .withColumn("seen_at", F.lit(seen_at))
    )
    return upsert(seen, new, ["account_id", "asset_id"], keep_old=("repo",))


def ledger_rows(
    accounts: DataFrame, repos: DataFrame, commits: DataFrame, findings: DataFrame, last_run_id: int,
    started_at: str, finished_at: str,
) -> DataFrame:
    """One row per scanned account with running totals over the accounts of this run.

    ``repos``, ``commits`` and ``findings`` carry account_id; each is counted before the join.
    """
    totals = accounts.select("account_id", "account_ord")
    for name, table in (("repos", repos), ("commits", commits), ("findings", findings)):
        counted = table.groupBy("account_id").agg(F.count(F.lit(1)).alias(f"account_{name}"))
        totals = totals.join(counted, "account_id", "left")
    totals = totals.na.fill(0).withColumn("one", F.lit(1)).withColumn("run", F.lit(0))
    summed = running_totals(
        totals, ["run"], "account_ord",
        {"one": "nth", "account_repos": "repos_scanned", "account_commits": "commits_scanned",
         "account_findings": "findings_count"},
    )
    return summed.select(
        (F.col("nth") + last_run_id).alias("run_id"),
        F.lit(started_at).alias("started_at"),
        F.lit(finished_at).alias("finished_at"),
        "account_id",
        "repos_scanned",
        "commits_scanned",
        "findings_count",
        "account_repos",
        "account_commits",
        "account_findings",
    )


def started_rows(accounts: DataFrame, last_run_id: int, started_at: str) -> DataFrame:
    """One unfinished ledger row per account of a run, numbered as ``ledger_rows`` will number them."""
    ones = accounts.select("account_id", "account_ord", F.lit(1).alias("one"), F.lit(0).alias("run"))
    none = {c: F.lit(None).cast("long") for c in (
        "repos_scanned", "commits_scanned", "findings_count", "account_repos", "account_commits", "account_findings")}
    return running_totals(ones, ["run"], "account_ord", {"one": "nth"}).select(
        (F.col("nth") + last_run_id).alias("run_id"), F.lit(started_at).alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"), "account_id", *[v.alias(c) for c, v in none.items()],
    )


def last_run(runs: DataFrame) -> DataFrame:
    """The newest run, finished or not."""
    return runs.orderBy(F.col("run_id").desc()).limit(1)


def last_finished_run(runs: DataFrame) -> DataFrame:
    return last_run(runs.where(F.col("finished_at").isNotNull()))


def write_version(table: DataFrame, folder: str, version: int) -> str:
    path = f"{folder.rstrip('/')}/v={version:010d}"
    table.write.mode("overwrite").parquet(path)
    return path
