"""A folder as tables: every file under it, what is not entered, and the texts of those that are texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.files import NOISE, PROSE, glob_regex, ignored, is_text, suffix

ROWS = "path string, bytes long, mtime double, content binary, excluded boolean, reason string"


def _rule(path: str, rules: list[str], noise: tuple[str, ...]) -> str | None:
    name = path.rstrip("/").rpartition("/")[2]
    if name.startswith("."):
        return "hidden"
    if name in noise:
        return "ignore rule"
    for rule in (r.strip() for r in rules):
        body = rule.strip("/")
        if not body or rule.startswith("#"):
            continue
        rooted = "/" in body or rule.startswith("/")
        if re.fullmatch(glob_regex(body), path.rstrip("/") if rooted else name):
            return "ignore rule"
    return None


def walk(spark: SparkSession, root: str, rules: list[str] | None = None, noise: tuple[str, ...] = NOISE) -> DataFrame:
    """(path, bytes, mtime, content, excluded, reason) of every file under root, paths relative to it.

    A folder that is hidden, a noise folder or named by a rule is one excluded row that ends with a slash; nothing in it
    is listed. A folder on a file system is listed here, names only, and read by the executors; an address of another
    store is listed and read by Spark, which leaves out names that start with a dot or an underscore.
    """
    if re.match(r"(?!file:)[a-z0-9]+://", root):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/*", "")
        rows = files.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").cast("double").alias("mtime"), "content")
        out = ignored(F.col("path"), rules or [], noise)
        return rows.withColumn("excluded", out).withColumn("reason", F.when(out, "ignore rule"))
    base = re.sub("^file:/*", "/", root).rstrip("/")
    found: list[tuple] = []
    todo = [""]
    while todo:
        folder = todo.pop()
        for e in sorted(os.scandir(f"{base}/{folder}"), key=lambda e: e.name):
            rel = f"{folder}{e.name}"
            why = _rule(rel, rules or [], noise)
            if e.is_dir(follow_symlinks=False):
                if why:
                    found.append((f"{rel}/", None, None, True, why))
                else:
                    todo.append(f"{rel}/")
            elif e.is_file():
                st = e.stat()
                found.append((rel, st.st_size, st.st_mtime, why is not None, why))
    listed = spark.createDataFrame(found, "path string, bytes long, mtime double, excluded boolean, reason string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content: list[bytes | None] = []
            for path, out in zip(b["path"], b["excluded"], strict=True):
                try:
                    with open(f"{base}/{path}", "rb") as file:
                        content.append(None if out else file.read())
                except OSError:
                    content.append(None)
            b.insert(3, "content", content)
            yield b

    return listed.mapInPandas(read, ROWS)


def corpus(files: DataFrame, endings: tuple[str, ...] = PROSE) -> DataFrame:
    """(key, name, text, mtime) of the texts among files; a text that isn't valid UTF-8 has its bad bytes replaced."""
    kept = files.where(~F.col("excluded") & F.col("content").isNotNull() & suffix(F.col("path")).isin(*endings) & is_text(F.col("path"), F.col("content")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return kept.select(F.col("path").alias("key"), name.alias("name"), text.alias("text"), "mtime")
