"""A crawl's folder: a Parquet table for each of schema.TABLES, and one that tells what it is."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, VERSION
from ..shipping import shared_dir

META = "_meta"


class NotACrawl(ValueError):
    pass


class TooNew(ValueError):
    pass


def cut(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, which executors share, and read back. With file_rows no file has more rows, so that
    what one task wrote can be read by many."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trawl-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save(tables: dict[str, DataFrame], root: str, analysed: bool = False) -> None:
    """Every table, and last the mark that makes the folder a crawl."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(analysed).alias("analysed")).coalesce(1).write.mode("overwrite").parquet(f"{root}/{META}")


def open_crawl(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that the folder has; tables without rows yet are empty."""
    try:
        mark = spark.read.parquet(f"{root}/{META}").first()
    except AnalysisException as e:
        raise NotACrawl(root) from e
    if mark is None or "version" not in mark:
        raise NotACrawl(root)
    if mark["version"] > VERSION:
        raise TooNew(f"{root}: version {mark['version']}, this is {VERSION}")
    out = {}
    for name, schema in TABLES.items():
        try:
            out[name] = spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out
