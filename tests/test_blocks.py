"""Files that stay the same over commits travel as one row per block of commits."""

from pyspark.sql import functions as F

from sparkwarden.plans import scan as sc


def tables(spark, n_commits=200, n_files=30, twice=0):
    """One repository whose files change every 50th commit, and a small one; the tree may list files twice."""
    accounts = spark.createDataFrame([("a", 0, ["token"]), ("b", 1, None)], "account_id string, account_ord int, keywords array<string>")
    repos = spark.createDataFrame([("a", "a/big", 0, False, False), ("b", "b/small", 1, False, False)], "account_id string, repo string, repo_ord int, fork boolean, archived boolean")
    k = F.col("id")
    big = spark.range(n_commits).select(F.lit("a/big").alias("repo"), F.md5(k.cast("string")).alias("commit_sha"), k.cast("int").alias("commit_ord"), k.alias("k"))
    small = spark.range(3).select(F.lit("b/small").alias("repo"), F.md5(F.concat(F.lit("s"), k)).alias("commit_sha"), k.cast("int").alias("commit_ord"), (k + 1000).alias("k"))
    commits = big.unionByName(small).repartition(3, "commit_sha")
    files = commits.select("commit_sha", "k", F.explode(F.sequence(F.lit(0), F.lit(n_files - 1))).alias("f"))
    files = files.select(
        "commit_sha", F.concat(F.lit("src/f"), "f", F.lit(".ts")).alias("path"),
        F.md5(F.concat_ws("-", "f", F.floor(F.col("k") / F.when(F.col("f") == 0, 50).otherwise(100_000)))).alias("blob_sha"), F.lit(10).cast("long").alias("size"),
    )
    files = files.unionByName(files.where("path = 'src/f1.ts'").limit(twice)) if twice else files
    blobs = files.select("blob_sha").distinct().select("blob_sha", F.concat(F.lit("a token, mail mira@north-post.co.uk "), "blob_sha").alias("text"))
    images = spark.createDataFrame([], "blob_sha string, meta_json string")
    return sc.ScanTables(accounts, repos, commits.drop("k"), files, blobs, images)


def test_rows_fall_by_the_repeat_rate(spark):
    t = tables(spark)
    commits = sc.numbered_commits(sc.selected_commits(t))
    blocks, files = sc.planned_blocks(t, commits), sc.planned_files(t)
    assert files.count() == 30 * 203 and blocks.count() < 30 * 203 / 30
    columns = ["account_id", "repo", "commit_sha", "commit_ord", "path", "blob_sha", "route"]
    assert sorted(map(tuple, sc.expand_blocks(blocks, commits).select(columns).collect())) == sorted(map(tuple, files.select(columns).collect()))


def test_findings_of_blocks(spark):
    t = tables(spark, 70, 4)
    found = sc.scan(t)
    per_commit = found.groupBy("commit").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).collect()
    assert len(per_commit) == 73 and {r.files for r in per_commit} == {4}
    assert found.where("account = 'a' and rule = 'email-address'").count() == 70 * 4
    assert found.where("severity is null or commit is null or commit_ord is null").count() == 0
    restricted = sc.scan(t, restricted=True)
    assert sorted(map(repr, restricted.collect())) == sorted(map(repr, found.collect()))


def test_files_listed_twice_stay_two(spark):
    t = tables(spark, 70, 3, twice=5)
    commits = sc.numbered_commits(sc.selected_commits(t))
    blocks, files = sc.planned_blocks(t, commits), sc.planned_files(t)
    columns = ["repo", "commit_sha", "path", "blob_sha"]
    assert files.count() == 3 * 73 + 5
    assert sorted(map(tuple, sc.expand_blocks(blocks, commits).select(columns).collect())) == sorted(map(tuple, files.select(columns).collect()))


def test_files_listed_twice_do_not_read_the_tree_again(spark, monkeypatch):
    """A second row of the block holds them; only files listed three times or more need the tree."""
    read = []
    planned = sc.planned_files
    monkeypatch.setattr(sc, "planned_files", lambda *args, **kw: read.append(1) or planned(*args, **kw))
    for times, reads in ((1, 1), (2, 2)):
        t = tables(spark, 70, 3)
        t = sc.replace(t, tree=t.tree.unionByName(spark.createDataFrame(t.tree.where("path = 'src/f1.ts'").limit(2).collect() * times, t.tree.schema)))
        commits = sc.numbered_commits(sc.selected_commits(t))
        read.clear()
        blocks = sc.planned_blocks(t, commits)
        assert len(read) == reads
        columns = ["repo", "commit_sha", "path", "blob_sha"]
        assert sorted(map(tuple, sc.expand_blocks(blocks, commits).select(columns).collect())) == sorted(map(tuple, planned(t).select(columns).collect()))
