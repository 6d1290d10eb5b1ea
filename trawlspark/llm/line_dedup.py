"""Line dedup by distinct-site spread, in DataFrame functions only.

For every line hash two HyperLogLog sketches are merged by aggregation: of the
sites (``source``) that hold the line and of the distinct texts that do. A line
is boilerplate if it spreads over at least MIN_SITES sites and MIN_SITES distinct
texts (exact copies of one document alone, whatever their number, make none of
their lines boilerplate). Where an estimate lies within MARGIN of the threshold,
the exact distinct counts of that line decide. All occurrences of boilerplate
lines are removed.

Lines split at line feeds; a line's key is a pair of 64-bit hashes of the line
without surrounding ASCII white space. Lines without a word are never removed.
Aggregation combines on the map side, so a line that a third of all documents
hold sends one sketch from each task.

Defined results: null texts have no lines and come back as they are; a null
source is one site; repeated rows count once in both sketches; rows that share a
doc_id, or have none, keep their own lines; a line at the threshold goes; a text of
any length is one row's work; extra columns are kept in ``dedup_lines`` and take no
part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, with_row_keys

MIN_SITES = 10
#: Line hashes that are broadcast, at most (about 40 bytes each), and the parts a line's occurrences are dealt to beyond that.
BROADCAST_LINES, SALTS = 500_000, 64
LG_K = 11
#: Four standard errors of the sketches (1.04 / sqrt(2 ** LG_K)).
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def occurrences(rows: DataFrame) -> DataFrame:
    """rows (see common.with_row_keys) -> (key, site, version, at, h1, h2): a row for every line with a word."""
    d = rows.select("key", F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("site"), F.xxhash64("row.text").alias("version"), F.posexplode(split_lines(F.col("row.text"))).alias("at", "line"))
    d = d.select("key", "site", "version", "at", F.btrim("line", F.lit(BLANKS)).alias("line")).filter("line != ''")
    return d.select("key", "site", "version", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _held(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """The occurrences of the lines in hashes (h1, h2). Few of them are broadcast; beyond that the join is salted, since a line may be in a third of
    all documents."""
    n = hashes.count()
    if n <= BROADCAST_LINES:
        return lines.join(F.broadcast(hashes), ["h1", "h2"], "left_semi")
    salted = hashes.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"], "left_semi").drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that spread over min_sites sites and texts."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sites"), F.hll_sketch_agg("version", LG_K).alias("texts"))
    seen = spread.select("h1", "h2", F.hll_sketch_estimate("sites").alias("sites"), F.hll_sketch_estimate("texts").alias("texts"))
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    seen = materialize(seen.filter((F.col("sites") >= low) & (F.col("texts") >= low)), "spread")
    sure = seen.filter((F.col("sites") > high) & (F.col("texts") > high)).select("h1", "h2")
    near = seen.filter((F.col("sites") <= high) | (F.col("texts") <= high)).select("h1", "h2")
    # Distinct (line, site) and (line, text) first: what meets in one task is a line's distinct values, not its rows.
    held = _held(lines, near)
    exact = held.select("h1", "h2", F.lit(0).alias("kind"), F.xxhash64("site").alias("v")).unionByName(held.select("h1", "h2", F.lit(1).alias("kind"), F.col("version").alias("v"))).distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count_if(F.col("kind") == 0).alias("sites"), F.count_if(F.col("kind") == 1).alias("texts"))
    return sure.unionByName(exact.filter((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites)).select("h1", "h2"))


def cleaned(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """row (each document's columns), text (without boilerplate lines), n_lines, n_removed (long)."""
    packed = with_row_keys(documents)
    lines = occurrences(packed)
    found = materialize(boilerplate(lines, min_sites), "boilerplate")
    drop = _held(lines, found).groupBy("key").agg(F.collect_set("at").alias("drop"))
    j = packed.join(drop, "key", "left").withColumn("lines", split_lines(F.col("row.text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return j.select("row", text.alias("text"), F.greatest(F.lit(0), n_lines).cast("long").alias("n_lines"), F.greatest(F.lit(0), F.coalesce(F.size("drop"), F.lit(0))).cast("long").alias("n_removed"))


def dedup_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """documents with text cleaned, and n_lines and n_removed (in the place of columns that have these names)."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in ("text", "n_lines", "n_removed")]
    return cleaned(documents, min_sites).select(*kept, "text", "n_lines", "n_removed")
