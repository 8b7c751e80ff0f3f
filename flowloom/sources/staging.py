"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none, as in tests, gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="flowloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def staged(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """df written and read again: later plans start from files, and a lost executor costs a reread only. The table stays until cleared() is called, as what is
    returned, and whatever is made of it, reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/flowloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not whenever the driver happens to collect its garbage; for operators that write
    one stage after the other and read it from its table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cleared(spark: SparkSession) -> None:
    """Removes all tables that this application has staged; for when their results have been written elsewhere."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/flowloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
