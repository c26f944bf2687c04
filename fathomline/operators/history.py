"""What a repository's history says: latest commits, changes since, records that their code has moved away from."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUB = 3


def git_log(spark: SparkSession, root: str, since: int | None = None) -> DataFrame:
    """(sha, at, path): a row for each file of each commit; empty where there is no repository."""
    command = ["git", "-C", root, "log", "--format=@%H %ct", "--name-only", *([f"--since=@{since}"] if since is not None else [])]
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    rows, sha, at = [], "", 0
    for line in done.stdout.splitlines() if not done.returncode else []:
        if line.startswith("@"):
            sha, _, stamp = line[1:].partition(" ")
            at = int(stamp)
        elif line:
            rows.append((sha, at, line))
    return spark.createDataFrame(rows, "sha string, at long, path string")


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): tracked files and untracked ones that no rule ignores."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, text=True, check=False)
    return spark.createDataFrame([(p,) for p in sorted(set(done.stdout.split("\0"))) if p] if not done.returncode else [], "path string")


def latest_commits(log: DataFrame) -> DataFrame:
    """(path, sha, at): the last commit of each file."""
    return log.groupBy("path").agg(F.max_by("sha", F.struct("at", "sha")).alias("sha"), F.max("at").alias("at"))


def touched_since(log: DataFrame, moment: int) -> DataFrame:
    return log.where(F.col("at") > moment).select("path").distinct()


def drift(log: DataFrame, records: DataFrame, hub: int = HUB) -> DataFrame:
    """(record, commits): commits to the files that a record lists after the record's own last commit.

    records has record, path, mtime (the anchor where the log doesn't know the record); a path may be a file or a folder.
    Files that `hub` or more records list say nothing and are left out. An interval join: on the path, after the anchor.
    """
    popular = records.groupBy("path").agg(F.count_distinct("record").alias("n"))
    own = records.join(popular.where(F.col("n") < hub), "path")
    last = log.groupBy(F.col("path").alias("record")).agg(F.max("at").alias("last"))
    anchored = own.join(last, "record", "left").select("record", "path", F.coalesce("last", F.floor("mtime")).alias("anchor"))
    parts = F.split("path", "/")
    # a commit's file with each folder it lies in: covering becomes equality
    above = log.select("sha", "at", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    hit = above.join(anchored.withColumn("path", F.regexp_replace("path", "/+$", "")), "path").where(F.col("at") > F.col("anchor"))
    return hit.groupBy("record").agg(F.count_distinct("sha").alias("commits"))
