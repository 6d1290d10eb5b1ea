"""What the operators of this subpackage share: the shared folder for cut lineage and narrowing by ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shared_dir

#: Ids are broadcast only up to this many rows (two longs each in Spark's hashed relation: 16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

#: ASCII white space between words.
BLANKS = " \t\n\x0b\f\r"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trawl-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() made and that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def select_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", count: int | None = None) -> DataFrame:
    """df's rows whose key is in ids (left_semi) or is not (left_anti). The ids are broadcast if there are few enough, else both sides shuffle."""
    n = ids.count() if count is None else count
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


#: Keys from here on stand for rows without a doc_id; doc_ids are below.
NO_ID = 1 << 62


def key_of(doc_id: Column, text: Column) -> Column:
    """doc_id, or for null a key from NO_ID on, made of the text: rows without doc_id keep their own decisions."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID)))


def with_texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id (a key, never null), text (never null) and the columns named, and no other column: extra columns can't clash."""
    return documents.select(key_of(F.col("doc_id"), F.col("text")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def with_row_keys(documents: DataFrame) -> DataFrame:
    """row (the document's columns) and key: doc_id; where it is null, or several rows have it, a key made of it and the text.

    So rows of one doc_id but different texts keep apart, and equal rows share a key.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    rows = documents.select(row, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("own"))
    again = materialize(documents.select(F.col("doc_id").cast("long").alias("again")).groupBy("again").count().filter("count > 1 and again is not null").select("again"), "again")
    n = again.count()
    if n == 0:
        return rows.select("row", key_of(F.col("id"), F.col("own")).alias("key"))
    j = rows.join(F.broadcast(again) if n <= BROADCAST_IDS else again, F.col("id") == F.col("again"), "left")
    return j.select("row", F.when(F.col("again").isNull(), key_of(F.col("id"), F.col("own"))).otherwise(F.lit(NO_ID) + F.pmod(F.xxhash64("id", "own"), F.lit(NO_ID))).alias("key"))


def restored(df: DataFrame, *columns: str) -> DataFrame:
    """df with null again where the columns hold keys that stand for no doc_id."""
    return df.withColumns({c: F.when(F.col(c) < NO_ID, F.col(c)) for c in columns or ("doc_id",)})


def rows_without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """df's rows, with its columns as they are, whose key is not in keys (doc_id)."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), key_of(F.col("doc_id"), F.col("text")).alias("doc_id"))
    return select_ids(packed, keys, "doc_id", "left_anti").select("row.*")
