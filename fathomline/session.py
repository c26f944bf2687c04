"""Session settings, the shared work folder and the small helpers every operator uses."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fathomline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one is made for a local master (tests);
    on a cluster that is an error, as a folder of one machine would not be seen by the others."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, made, True)
        place = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


RUN = uuid.uuid4().hex  # of this process: its intermediate tables lie in one folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    Plans made from it read it later, so it stays until release() or the end of the process.
    """
    spark = df.sparkSession
    place = f"{work_dir(spark)}/fathomline/{RUN}/{name}-{uuid.uuid4().hex}"
    if (where := f"{work_dir(spark)}/fathomline/{RUN}") not in _runs:
        _runs.add(where)
        atexit.register(_quietly, release, spark)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


_runs: set[str] = set()


def _quietly(action, *given) -> None:
    try:
        action(*given)
    except Exception:  # the session may be gone when the process ends
        return


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; plans made from them can't be run afterwards."""
    for where in sorted(_runs):
        files, path = shared(spark, where)
        files.delete(path, True)
        _runs.discard(where)


# --- small files in the shared folder -------------------------------------------------------------------------------


def shared(spark: SparkSession, place: str):
    """The file system of a place, and the place in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names_in(spark: SparkSession, place: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    files, path = shared(spark, place)
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


def read_small(spark: SparkSession, place: str) -> str:
    files, path = shared(spark, place)
    stream = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def claim(spark: SparkSession, place: str, content: str) -> bool:
    """Create a small file; False if it is there already. Of several writers exactly one gets it.

    The name is taken exclusively (a local file by the operating system, others by a create that doesn't overwrite, which
    is atomic where the file system says so), and the content follows: a reader that meets half of it takes the file
    before.
    """
    files, path = shared(spark, place)
    files.mkdirs(path.getParent())
    if files.getUri().getScheme() == "file":
        try:
            out = os.open(path.toUri().getPath(), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(out, "wb") as file:
            file.write(content.encode())
        return True
    try:
        stream = files.create(path, False)
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key: the one with the greatest mtime, then read_at, then content.

    Rows with a null key are dropped (they name no record). The aggregate combines before the shuffle.
    """
    order = [c for c in ("mtime", "read_at") if c in df.columns]
    kept = F.struct(*columns)
    newest = F.max_by(kept, F.struct(*order, *columns))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("_r")).select(key, "_r.*")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: one small file is otherwise one task, whatever it costs a
    byte. A table with more partitions than cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines_normalised(text: Column) -> Column:
    """Every line end made a single newline."""
    return F.regexp_replace(text, "\r\n?", "\n")
