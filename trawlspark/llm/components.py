"""Connected components of an edge table, by contraction.

Every round each vertex takes as parent the least of itself and its neighbours (an
aggregate that combines on the map side, so a hub costs one row from each task), by id
or, in every second round from the third on, by a hash of id and round; parents are
followed once more, and the edges are rewritten to the parents, without loops and
repeats. By id, groups around a hub end in two rounds. By hash, a constant share of the
vertices of any graph goes, also of a chain whose ids rise along it: the rounds are in
proportion to the logarithm of the vertices, and the tables shrink from round to round.
At the end the rounds' maps are put together, the smallest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows of a round's table in one file, about: later rounds are small, and a file for each of hundreds of partitions costs more than its rows.
FILE_ROWS = 250_000


def _parents(e: DataFrame, r: int) -> DataFrame:
    """(v, p): every vertex with its parent of round r."""
    rank = (lambda c: F.xxhash64(F.lit(r), c)) if r > 1 and r % 2 == 0 else (lambda c: c)
    ends = e.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("n")))
    least = ends.select("v", F.struct(rank(F.col("n")).alias("rank"), "n").alias("m")).groupBy("v").agg(F.min("m").alias("m"))
    return least.select("v", F.when(F.col("m") < F.struct(rank(F.col("v")).alias("rank"), F.col("v").alias("n")), F.col("m.n")).otherwise(F.col("v")).alias("p"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): component is the smallest id that can be reached."""
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    steps: list[tuple[DataFrame, int]] = []
    n = e.count()
    while not steps or n:
        files = -(-2 * n // FILE_ROWS) or 1  # at most two vertices for each edge
        parent = _parents(e, len(steps))
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = materialize(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")).coalesce(files), "parents")
        steps.append((step, files))
        pa, pb = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = e.join(pa, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct()
        before, e = e, materialize(moved.coalesce(files), "edges")
        discard(before)
        n = e.count()
    root = steps.pop()[0].withColumnRenamed("p", "root")
    while steps:
        last, (step, files) = root.select(F.col("v").alias("p"), "root"), steps.pop()
        root = materialize(step.join(last, "p", "left").select("v", F.coalesce("root", "p").alias("root")).coalesce(files), "roots")
    least = root.groupBy("root").agg(F.min("v").alias("component"))
    return root.join(least, "root").select(F.col("v").alias("id"), "component")
