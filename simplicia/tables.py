"""Tables that are written in between, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-simplicia-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends there, a lost executor costs a reread,
    and the known size lets Spark choose join strategies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/simplicia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = (path, None)
    return back


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``written``, dealt by the hash of ``key`` into so many buckets: joins of two such tables on the key move no rows."""
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/simplicia/{name}-{unique}", f"simplicia_{unique}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    back = spark.table(table)
    back._written = (path, table)
    return back


def filesystem(spark: SparkSession, path: str):
    """Hadoop's (FileSystem, Path) of a path, for whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = filesystem(spark, path)
    return system.exists(where)


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` or ``bucketed`` made and that nothing reads any more."""
    path, table = df._written
    spark = df.sparkSession
    if table is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    system, where = filesystem(spark, path)
    system.delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with places from 0 in the order of its columns ``order``.

    Ranges of the order are sorted by a task each; a table of the ranges' sizes,
    a row for each, gives where the places of a range begin.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return rows.join(before, "__range").withColumn(name, F.col("__before") + F.col("__place")).select(*df.columns, name)
