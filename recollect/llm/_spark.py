"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local one of our own only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"recollect-{os.getpid()}")
    if not os.path.isdir(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._written = path
    return read


def release(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, most: int) -> DataFrame:
    """The inner join of rows with `keyed`, whose keys are distinct and say in `weight` how many rows have them.

    The `most` heaviest keys at most are broadcast, so no hot key is dealt to one task; the
    others, each in few rows, join by a shuffle.
    """
    held = keyed.groupBy(F.least(F.col(weight), F.lit(100_000)).alias("w")).count().collect()
    least, left = 0, 0
    for r in sorted(held, key=lambda r: -r["w"]):
        left += r["count"]
        if left > most:
            least = r["w"] + 1
            break
    found = rows.join(F.broadcast(keyed.filter(F.col(weight) >= least).drop(weight)), on)
    if least:
        found = found.unionByName(rows.join(keyed.filter(F.col(weight) < least).drop(weight), on))
    return found


TEXTS_PER_BATCH = 1000


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow` over texts: batches of fewer rows than Spark's 10,000, as a row may be a whole book."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= TEXTS_PER_BATCH:
        df.sparkSession.conf.set(name, str(TEXTS_PER_BATCH))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
