"""What the llm operators share: the shared folder, written tables, column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a local master gets a temporary folder, as in tests; on a cluster that is an error, as a folder of the driver's machine
    isn't the executors'.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and it outlives any executor; `release` removes it."""
    path = f"{shared_folder(df.sparkSession)}/gristmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of tables written so far, for `release`."""
    return len(_written)


def release(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Removes the written tables from number `start` up to `end`; results that still read them must have been used by then."""
    for path in _written[start:end]:
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for k in range(start, len(_written) if end is None else end):
        _written[k] = ""


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table in the shared folder; Spark removes it with the DataFrame."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores in front until no column of `df` has it, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def kind_of(df: DataFrame, column: str) -> str:
    """The type of a column, as in a schema string."""
    return df.select(column).schema[0].dataType.simpleString()


def unit(column, seed: int):
    """A uniform number in [0, 1) from a seeded MD5 of `column`; other SQL engines can compute the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
