"""Raw listing records to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..model import ScanOptions


def normalize_accounts(raw: DataFrame) -> DataFrame:
    """Accounts with ``enabled`` filled in; a row without id or user makes the job fail.

    The check is part of the plan (``raise_error``), so no extra pass and no collect.
    """
    missing = (F.coalesce("account_id", F.lit("")) == "") | (F.coalesce("user", F.lit("")) == "")
    checked = F.when(
        missing, F.raise_error(F.lit("Invalid account: account_id and user are required"))
    ).otherwise(F.col("account_id"))
    rest = [c for c in raw.columns if c not in ("account_id", "enabled")]
    return raw.select(
        checked.cast("string").alias("account_id"), *rest, F.coalesce("enabled", F.lit(True)).alias("enabled")
    )


def enabled_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts that are not switched off; a missing mark counts as on."""
    return accounts.where(F.coalesce("enabled", F.lit(True)))


def account_by_id(accounts: DataFrame, account_id: str) -> DataFrame:
    """The first account of that id, enabled or not."""
    return accounts.where(F.col("account_id") == account_id).orderBy("account_ord").limit(1)


def shape_repos(raw: DataFrame) -> DataFrame:
    unknown = F.lit("unknown")
    rest = [c for c in raw.columns if c not in
            ("name", "full_name", "default_branch", "fork", "archived", "pushed_at")]
    return raw.select(
        *rest,
        F.coalesce("name", "full_name", unknown).alias("name"),
        F.coalesce("full_name", "name", unknown).alias("repo"),
        F.coalesce("default_branch", F.lit("main")).alias("default_branch"),
        F.coalesce("fork", F.lit(False)).alias("fork"),
        F.coalesce("archived", F.lit(False)).alias("archived"),
        F.coalesce("pushed_at", F.lit("")).alias("pushed_at"),
    )


def filter_repos(repos: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Without forks and archived repositories; a missing mark counts as no."""
    for mark, included in (("fork", options.include_forks), ("archived", options.include_archived)):
        if not included:
            repos = repos.where(~F.coalesce(mark, F.lit(False)))
    return repos


def shape_commits(raw: DataFrame) -> DataFrame:
    rest = [c for c in raw.columns if c not in ("sha", "commit", "author")]
    return raw.select(
        *rest,
        "sha",
        F.col("commit.message").alias("message"),
        F.coalesce("commit.author.date", "commit.committer.date", F.lit("")).alias("date"),
        F.coalesce("commit.author.name", "author.login", F.lit("unknown")).alias("author"),
    )


def shape_tree(raw: DataFrame) -> DataFrame:
    """Only blobs; a missing size is 0."""
    rest = [c for c in raw.columns if c not in ("size", "type")]
    return raw.where(F.col("type") == "blob").select(
        *rest, F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.lit("file").alias("type")
    )


def _from_base64(content: Column) -> Column:
    """Lenient: both alphabets, foreign characters skipped, end at the first "=", odd tail dropped."""
    digits = F.regexp_replace(
        F.translate(F.split_part(content, F.lit("="), F.lit(1)), "-_", "+/"), "[^A-Za-z0-9+/]", ""
    )
    whole = once(digits, lambda d: F.when(F.length(d) % 4 == 1, F.left(d, F.length(d) - 1)).otherwise(d))
    return F.make_valid_utf8(F.unbase64(whole).cast("string"))


def decode_content(raw: DataFrame) -> DataFrame:
    """Plain text as it is, base64 as UTF-8 with bad bytes replaced; anything else is dropped.

    What is dropped shows in the raw columns, so nothing is decoded to find out.
    """
    plain, encoded = F.col("encoding").isNull(), F.col("encoding") == "base64"
    readable = raw.where((plain & F.col("content").isNotNull()) | (encoded & (F.col("content") != "")))
    text = F.when(plain, F.col("content")).otherwise(_from_base64(F.col("content")))
    rest = [c for c in raw.columns if c not in ("content", "encoding")]
    return readable.select(*rest, text.alias("text"))


def shape_gists(raw: DataFrame) -> DataFrame:
    rest = [c for c in raw.columns if c not in ("id", "files", "public", "updated_at")]
    no_files = F.create_map().cast("map<string,string>")
    return raw.select(
        *rest,
        F.coalesce("id", F.lit("")).alias("gist_id"),
        F.map_keys(F.coalesce("files", no_files)).alias("files"),
        F.coalesce("public", F.lit(False)).alias("public"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"),
    )


def gist_files(raw: DataFrame) -> DataFrame:
    """One row per gist file that has content."""
    return raw.select(F.col("id").alias("gist_id"), F.explode("files").alias("path", "text")).where(
        F.length("text") > 0
    )


def release_assets(raw: DataFrame) -> DataFrame:
    """One row per asset of every release."""
    rest = [c for c in raw.columns if c != "assets"]
    return raw.select(*rest, F.explode("assets").alias("asset")).select(
        *rest,
        F.col("asset.id").alias("asset_id"),
        F.col("asset.name").alias("name"),
        F.col("asset.browser_download_url").alias("url"),
    )
