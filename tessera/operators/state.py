"""Tables between the steps of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in the warehouse, which executors share as well."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: its lineage ends there, and lost
    executors cost only a read. The files go when the JVM ends, or earlier by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tessera_path", None):
            fs, where = _file_system(df.sparkSession, path)
            fs.delete(where, True)
            df._tessera_path = None
