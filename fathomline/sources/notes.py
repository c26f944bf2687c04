"""A table of notes that can be written to: compare-and-set by version, properties, deletion, snapshots and their undoing.

Notes are rows (path, text, mtime, deleted, batch) in Parquet folders that are never changed, and a log that numbers
them: a batch counts once its log entry is created, which only one writer can do for a number. A writer checks what it
expects against the batches before its own; overtaken, it checks again against the newer state. The present state is the
latest row of a path, and every earlier state can be selected again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import version
from fathomline.operators.files import contained
from fathomline.operators.prose import dump_front, split_front
from fathomline.session import claim, names_in, read_small, shared, stash

SCHEMA = "path string, text string, mtime double, deleted boolean, batch long"


class Changed(ValueError):
    """The note isn't in the state the writer expected."""


@dataclass(frozen=True)
class Notes:
    spark: SparkSession
    folder: str
    within: str = ""  # writes go under this folder only

    def log(self) -> list[str]:
        """The data folders of the batches, in order; an entry that is still being written ends the list."""
        out = []
        for name in names_in(self.spark, f"{self.folder}/log"):
            data = read_small(self.spark, f"{self.folder}/log/{name}")
            if not data.endswith("\n"):
                break
            out.append(data.strip())
        return out

    def rows(self, log: list[str] | None = None) -> DataFrame:
        log = self.log() if log is None else log
        places = [f"{self.folder}/data/{x}" for x in log]
        return self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)

    def state(self, at: int | None = None) -> DataFrame:
        """(path, text, mtime, version) now, or as of a batch."""
        rows = self.rows(self.log()[:at])
        last = rows.groupBy("path").agg(F.max_by(F.struct("text", "mtime", "deleted"), "batch").alias("r")).where("not r.deleted")
        return last.select("path", "r.text", "r.mtime", version(F.col("r.text")).alias("version"))

    def snapshot(self) -> int:
        """The batch to come back to."""
        return len(self.log())

    def restore(self, batch: int) -> DataFrame:
        """Undo what came after a batch: what was created goes, what was changed or deleted is as it was. Returns
        (path, operation)."""
        before, now = self.state(batch), self.state()
        both = before.select("path", F.col("text").alias("old"), F.col("mtime").alias("stamp")).join(now.select("path", F.col("text").alias("new")), "path", "full_outer")
        kind = F.when(F.col("old").isNull(), "delete_created").when(F.col("new").isNull(), "recreate_deleted").otherwise("restore_version")
        undo = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", kind.alias("operation"), "old", "stamp")
        undo = stash(undo, "notes-undo")
        self._append(undo.select("path", F.coalesce("old", F.lit("")).alias("text"), F.coalesce("stamp", F.lit(0.0)).alias("mtime"), F.col("old").isNull().alias("deleted")))
        return undo.select("path", "operation")

    def _append(self, rows: DataFrame, check: Callable[[int], None] = lambda batch: None, attempts: int = 50) -> None:
        """Write rows as the next batch. check(n) raises if the state of the first n batches isn't what the writer
        expects; it is asked again whenever another writer took the number."""
        for _ in range(attempts):
            number = self.snapshot()
            check(number)
            name = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            rows.withColumn("batch", F.lit(number + 1).cast("long")).write.parquet(f"{self.folder}/data/{name}")
            if claim(self.spark, f"{self.folder}/log/{number + 1:012d}", name + "\n"):
                return
            files, path = shared(self.spark, f"{self.folder}/data/{name}")
            files.delete(path, True)
            time.sleep(0.05)
        raise Changed("other writers kept being faster")

    def one(self, path: str, at: int | None = None) -> tuple[str, str] | None:
        row = self.state(at).where(F.col("path") == path).select("text", "version").first()
        return (row["text"], row["version"]) if row else None

    def write(self, path: str, text: str, *, expect_version: str | None = None, create_only: bool = False, properties: dict | None = None) -> str:
        """Write a note and return its version; Changed if it isn't at expect_version, or is there and mustn't be."""
        path = contained(path)
        if self.within and not path.startswith(self.within.strip("/") + "/"):
            raise ValueError(f"{path} is not under {self.within}")

        def check(batch: int) -> None:
            have = self.one(path, batch) if expect_version is not None or create_only else None
            if create_only and have:
                raise Changed(f"{path} exists")
            if expect_version is not None and (have is None or have[1] != expect_version):
                raise Changed(f"{path} is not at {expect_version}")

        if properties:
            data, _, body = split_front(text)
            text = dump_front({**(data or {}), **properties}, body)
        self._append(self.spark.createDataFrame([(path, text, time.time(), False)], "path string, text string, mtime double, deleted boolean"), check)
        return self.spark.range(1).select(version(F.lit(text))).first()[0]

    def write_many(self, rows: DataFrame) -> None:
        """Upsert notes (path, text, mtime)."""
        self._append(rows.select("path", "text", "mtime", F.lit(False).alias("deleted")))

    def append(self, path: str, text: str) -> str:
        """Add text to a note, or begin it; Changed if another writer changed it meanwhile."""
        have = self.one(contained(path))
        return self.write(path, (have[0] if have else "") + text, expect_version=have[1] if have else None, create_only=not have)

    def set_property(self, path: str, name: str, value: object) -> str:
        have = self.one(contained(path))
        if not have:
            raise Changed(f"{path} is not there")
        return self.write(path, have[0], expect_version=have[1], properties={name: value})

    def delete(self, path: str) -> None:
        path = contained(path)
        self._append(self.spark.createDataFrame([(path, "", time.time(), True)], "path string, text string, mtime double, deleted boolean"))

    def move(self, path: str, to: str) -> None:
        have = self.one(contained(path))
        if not have:
            raise Changed(f"{path} is not there")
        self.write(to, have[0], create_only=True)
        self.delete(path)
