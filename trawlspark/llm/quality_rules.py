"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets counts (``counts``), and from them a few ratios in integer
steps (``RATIOS``). For each (lang, source) and ratio a mergeable quantile sketch
is kept: a histogram of log-linear cells (exact below 2 * CELLS, then CELLS cells
per doubling, so a relative error of at most 1 / CELLS), merged by adding counts.
Adding is exact and in no order, so a rerun task gives the same sketch, and Spark
combines on the map side, so that a source with a third of all rows costs no more
than any other. A group with fewer than MIN_GROUP documents takes the merged
sketch of its language, and a small language that of all rows.

A document is rejected if a ratio lies beyond its group's outer fence
(quartile +- FENCE * (q3 - q1), and SLACK steps more so that a group of alike
documents rejects none for a small deviation), or if it fails the base rules.

Defined results: a null text has no words (all counts 0) and fails the base
rules; null lang or source form groups of their own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize

CELLS = 32
MIN_GROUP = 200
FENCE = 3.0
#: ratio: (numerator, factor, denominator, slack in steps, whether a low value is rejected too)
RATIOS = {
    "word_length": ("word_chars", 100, "n_words", 250, True),
    "symbols": ("n_symbols", 1000, "word_chars", 50, False),
    "shouted": ("n_shouted", 1000, "word_chars", 200, False),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 350, False),
    "repeats": ("n_repeat_words", 1000, "n_words", 100, False),
}
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, an alias may be inlined into a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(grams: Column, width: int = 5) -> Column:
    """Words covered by windows whose hash occurs twice or more in grams, the window hashes in order."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)))
        at = F.array_sort(F.transform(twice, lambda i: F.get(s, i)["p"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return _let(at, total)

    return _let(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), covered)


def counts(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouted (long)."""
    text, blank = F.col("text"), "[ \\t\\n\\x0B\\f\\r]+"
    d = documents.select("doc_id", *keep, F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", *keep, "text", F.filter(F.split("text", blank), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"))
    d = d.select(
        "doc_id", *keep, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.translate("text", BLANKS, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z!]+", "")).alias("n_shouted"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    at = lambda i, k: F.get("h", i + k)
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))
    d = d.withColumn("grams", F.when(F.col("n") >= 5, grams).otherwise(F.array().cast("array<bigint>")))
    repeats = F.when(F.size(F.array_distinct("grams")) == F.size("grams"), F.lit(0)).otherwise(repeated_words(F.col("grams")))
    named = {"n_words": F.col("n"), "n_repeat_words": repeats} | {c: F.col(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_shouted")}
    return d.select("doc_id", *keep, *(c.cast("long").alias(k) for k, c in named.items()))


def cell(x: Column) -> Column:
    """The sketch's cell of an integer >= 0: itself below 2 * CELLS, then CELLS cells per doubling. Integer arithmetic only."""
    shift = F.greatest(F.lit(0), F.length(F.bin(x)) - F.lit(CELLS.bit_length()))
    return F.when(x < 2 * CELLS, x).otherwise(shift * CELLS + F.expr("0").cast("long") + F.call_function("shiftright", x, shift.cast("int")))


def cell_floor(c: Column) -> Column:
    """The least integer of a cell."""
    shift = F.floor(c / CELLS).cast("int") - 1
    return F.when(c < 2 * CELLS, c).otherwise(F.call_function("shiftleft", c - shift * CELLS, shift))


def ratios(stats: DataFrame) -> list[Column]:
    return [F.coalesce(F.expr(f"try_divide({num} * {k}, {den})").cast("long"), F.lit(0)).alias(name) for name, (num, k, den, _, _) in RATIOS.items()]


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, ratio, cell, n): the mergeable sketch of every group."""
    each = stats.filter("n_words > 0").select("lang", "source", F.inline(F.array(*(F.struct(F.lit(r).alias("ratio"), cell(F.col(r)).alias("cell")) for r in RATIOS))))
    return each.groupBy("lang", "source", "ratio", "cell").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and for each ratio low_ and high_): every group's fences. Its rows are the groups, its work the sketches' cells."""

    def fences(df: DataFrame, keys: list[str]) -> DataFrame:
        cells = df.groupBy(*keys, "ratio", "cell").agg(F.sum("n").alias("n"))
        group = cells.groupBy(*keys, "ratio").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
        # Cells are at most CELLS per doubling: a few hundred in a group, whatever its rows.
        def quantile(q: float) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
            step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] >= F.ceil(F.col("n") * q)), x["cell"]).otherwise(a["at"]).alias("at"))
            return cell_floor(F.aggregate("cells", start, step)["at"])

        f = group.select(*keys, "ratio", "n", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
        slack = F.create_map(*(F.lit(x) for r, (_, _, _, s, _) in RATIOS.items() for x in (r, s)))[F.col("ratio")]
        reach = (F.col("q3") - F.col("q1")) * FENCE + slack
        f = f.select(*keys, "ratio", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
        return f.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("ratio") == r, F.col(side))).alias(f"{side}_{r}") for r in RATIOS for side in ("low", "high")))

    names = [f"{side}_{r}" for r in RATIOS for side in ("low", "high")]
    own = fences(sketch, ["lang", "source"])
    lang = fences(sketch, ["lang"]).select(F.col("lang").alias("lang_"), F.col("n").alias("n_"), *(F.col(c).alias(f"{c}_") for c in names))
    whole = fences(sketch.withColumn("all", F.lit(1)), ["all"]).select(F.col("all"), *(F.col(c).alias(f"{c}__") for c in names))
    j = own.withColumn("all", F.lit(1)).join(lang, F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(whole), "all", "left")  # one row
    return j.select("lang", "source", *(F.when(F.col("n") >= MIN_GROUP, F.col(c)).when(F.col("n_") >= MIN_GROUP, F.col(f"{c}_")).otherwise(F.col(f"{c}__")).alias(c) for c in names))


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and ratios, base_failed, kept."""
    stats = counts(documents, "lang", "source")
    stats = materialize(stats.select("*", *ratios(stats)), "counts")
    cut = thresholds(sketches(stats)).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    j = stats.join(cut, stats["lang"].eqNullSafe(cut["lang_"]) & stats["source"].eqNullSafe(cut["source_"]), "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    outside = F.lit(False)
    for r, (*_, low) in RATIOS.items():
        outside = outside | F.coalesce(F.col(r) > F.col(f"high_{r}"), F.lit(False))
        if low:
            outside = outside | F.coalesce(F.col(r) < F.col(f"low_{r}"), F.lit(False))
    return j.select(*stats.columns, base.alias("base_failed"), (~base & ~outside).alias("kept"))
