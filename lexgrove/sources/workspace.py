"""Tables written between steps, numbers that run over a whole table without one task for all of it, and the package where tasks run."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PACKAGE = Path(__file__).resolve().parent.parent


@lru_cache(maxsize=1)
def archive() -> tuple[str, bytes]:
    """A name by content, and an archive of the package's sources."""
    sources = [(f"{PACKAGE.name}/{p.relative_to(PACKAGE).as_posix()}", p.read_bytes()) for p in sorted(PACKAGE.rglob("*.py"))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in sources:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return f"{PACKAGE.name}-{hashlib.sha256(repr(sources).encode()).hexdigest()[:16]}.zip", out.getvalue()


def shipped(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each Spark context: their Python workers start in folders of their own, and what
    they run refers to its modules by name. A package that is imported from an archive was sent as one."""
    context = spark.sparkContext
    if not PACKAGE.is_dir():
        return
    name, data = archive()
    if name not in context._python_includes:
        path = os.path.join(context._temp_dir, name)  # goes when the context stops
        Path(path).write_bytes(data)
        context.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only: executors elsewhere couldn't see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexgrove-checkpoints-"))
        folder = context.getCheckpointDir()
    return folder


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/lexgrove-{uuid.uuid4().hex}"


def stored(df: DataFrame, shrink: int = 1) -> DataFrame:
    """df as a table written to the shared folder; this cuts the lineage.

    shrink: how many of the session's shuffle partitions make one file, for tables whose rows are few or short."""
    spark = df.sparkSession
    path = new_path(spark)
    if shrink > 1:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // shrink))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lexgrove-" not in path:
                raise ValueError(f"{path} isn't a stored table")
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before a row, in an order that is unique.

    Rows are dealt to ranges of the order and written; each range sums up its own, and only one row for each range is added
    up as a whole."""
    ranges = stored(df.repartitionByRange(*order).withColumn("_range_", F.spark_partition_id()))
    before = Window.orderBy("_range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranges.groupBy("_range_").agg(F.sum(value).alias("_sum_")).select("_range_", F.coalesce(F.sum("_sum_").over(before), F.lit(0)).alias("_before_"))
    within = Window.partitionBy("_range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.withColumn("_within_", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(F.broadcast(sums), "_range_").withColumn(name, F.col("_before_") + F.col("_within_")).drop("_range_", "_before_", "_within_")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's number in an order that is unique, from 0."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")
