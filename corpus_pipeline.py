"""The corpus pipeline: raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents; the last one returns doc_id, n_tokens, ids
(binary, 4-byte unsigned little-endian integers), ids_sha256 and decoded_sha256.

Defined results: null and empty texts are rejected by the quality rules (too few words);
rows without doc_id are told apart by their texts; repeated rows are judged alike, and near
dedup leaves one of them; of documents at the threshold of a rule or a similarity the
operators' docstrings say which stay; texts of any length pass whole; extra columns, whatever
their names, are carried along; empty tables give empty tables in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlspark.llm import bpe, decontaminate, line_dedup, minhash_dedup, quality_rules
from trawlspark.llm.common import key_of, materialize, rows_without, select_ids
from trawlspark.llm.queries import tokenizer_path


def _without_rejected(docs: DataFrame, decided: DataFrame) -> DataFrame:
    return rows_without(docs, materialize(decided.filter(~F.col("kept")).select("doc_id"), "rejected"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed = docs.select(key_of(F.col("doc_id"), F.col("text")).alias("doc_id"), "text", "lang", "source")
    return _without_rejected(docs, quality_rules.quality_rules(keyed))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text."""
    out = line_dedup.cleaned(docs)
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return out.select(*(c.alias(k) for k, c in own.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest doc_id stays, and of its rows with the same text one."""
    decided = materialize(minhash_dedup.near_duplicates(docs).select("doc_id", "kept"), "decided")
    repeated = materialize(decided.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    return _one_of_each(_without_rejected(docs, decided), repeated)


def _one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with one row for each text of the keys (doc_id) that several rows have; rows of other keys as they are."""
    n = keys.count()
    if n == 0:
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key_of(F.col("doc_id"), F.col("text")).alias("doc_id"))
    one = select_ids(rows, keys, "doc_id", "left_semi", n).groupBy("doc_id", F.col("row.text")).agg(F.first("row").alias("row"))
    return select_ids(rows, keys, "doc_id", "left_anti", n).select("row.*").unionByName(one.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without_rejected(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded again for the round trip."""
    out = bpe.round_trip(docs, tokenizer_path())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: BPE merges can't be expressed in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
