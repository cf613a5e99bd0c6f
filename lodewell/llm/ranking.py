"""One ranking from several differently scaled scores (Borda count).

Each list gives every item points by its competition rank with ties averaged, so only the order within a
list counts, never its scale. Missing scores get mid-rank points or none, as asked. Points are weighted,
summed and sorted with the item id as tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.sources.tables import table

#: Lists are cut at these shares of their scores before ranks are counted; only balance depends on it.
CUTS = [i / 32 for i in range(1, 32)]


def list_ranks(hits: DataFrame, query: str, name: str, item: str, score: str) -> DataFrame:
    """(query, list, item, rank, n): average competition rank, 1 = best, among the n items of a list.

    Repeated items of a list count once with their best score. Null and NaN scores have no rank. No task
    holds a whole list: equal scores are collapsed first, each list is cut into score ranges at approximate
    quantiles, ranks are counted within a range and shifted by the totals of the ranges above it. The result
    is exact whatever the cuts are. Empty input gives no rows; null query or list values form their own list.
    """
    h = hits.select(F.col(query).alias("q"), F.col(name).alias("l"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    h = h.filter(F.col("s").isNotNull() & ~F.isnan("s") & F.col("i").isNotNull())
    best = h.groupBy("q", "l", "i").agg(F.max("s").alias("s"))
    levels = best.groupBy("q", "l", "s").agg(F.count(F.lit(1)).alias("c"))
    cuts = best.groupBy("q", "l").agg(F.percentile_approx("s", F.array(*map(F.lit, CUTS)), 1000).alias("cuts"))
    lv = levels.alias("a").join(cuts.alias("b"), F.col("a.q").eqNullSafe(F.col("b.q")) & F.col("a.l").eqNullSafe(F.col("b.l")))
    lv = lv.select("a.q", "a.l", "a.s", "a.c", F.expr("size(filter(b.cuts, x -> x < a.s))").alias("g"))
    within = Window.partitionBy("q", "l", "g").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    lv = lv.withColumn("above", F.coalesce(F.sum("c").over(within), F.lit(0)))
    totals = lv.groupBy("q", "l", "g").agg(F.sum("c").alias("t"))
    over = Window.partitionBy("q", "l").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("shift", F.coalesce(F.sum("t").over(over), F.lit(0))).withColumn("n", F.sum("t").over(Window.partitionBy("q", "l")))
    a, b = lv.alias("a"), totals.alias("b")
    ranked = a.join(b, F.col("a.q").eqNullSafe(F.col("b.q")) & F.col("a.l").eqNullSafe(F.col("b.l")) & (F.col("a.g") == F.col("b.g")))
    ranked = ranked.select("a.q", "a.l", "a.s", "b.n", (F.col("b.shift") + F.col("a.above") + (F.col("a.c") + 1) / 2).alias("r"))
    a, b = best.alias("a"), ranked.alias("b")
    out = a.join(b, F.col("a.q").eqNullSafe(F.col("b.q")) & F.col("a.l").eqNullSafe(F.col("b.l")) & (F.col("a.s") == F.col("b.s")))
    return out.select(F.col("a.q").alias(query), F.col("a.l").alias(name), F.col("a.i").alias(item), F.col("b.r").alias("rank"), "b.n")


def borda(
    hits: DataFrame,
    query: str = "query_id",
    name: str = "list_name",
    item: str = "chunk_id",
    score: str = "score",
    weights: dict[str, float] | None = None,
    missing: str = "none",
    k: int | None = None,
) -> DataFrame:
    """(query, item, points, position): the items of each query by weighted Borda points.

    A list of n items gives (n - rank + 1) / n points, so every list counts alike whatever its length or
    scale; a list of weight w counts w times (1 if not named). missing='none': an item that a list lacks,
    or for which it has no usable score, earns nothing there; 'mid': it earns the mid-rank (n + 1) / 2n of
    every list that the query has. Ties go to the smaller item. An item with no usable score at all has no
    row. k keeps the first k of each query, limited before the shuffle so that no query is gathered whole.
    """
    if missing not in ("none", "mid"):
        raise ValueError(missing)
    r = list_ranks(hits, query, name, item, score)
    w = F.lit(1.0)
    for key, value in (weights or {}).items():
        w = F.when(F.col(name) == key, float(value)).otherwise(w)
    earned = (F.col("n") - F.col("rank") + 1) / F.col("n")
    if missing == "mid":
        earned = earned - (F.col("n") + 1) / (2 * F.col("n"))
    pts = r.select(F.col(query).alias("q"), F.col(item).alias("i"), F.round(earned * w, 9).cast("decimal(24,9)").alias("p"))
    total = pts.groupBy("q", "i").agg(F.sum("p").alias("p"))
    if missing == "mid":
        lists = r.select(F.col(query).alias("q"), F.col(name), "n").distinct()
        base = lists.groupBy("q").agg(F.sum(F.round((F.col("n") + 1) / (2 * F.col("n")) * w, 9).cast("decimal(24,9)")).alias("base"))
        a, b = total.alias("a"), base.alias("b")
        total = a.join(b, F.col("a.q").eqNullSafe(F.col("b.q"))).select("a.q", "a.i", (F.col("a.p") + F.col("b.base")).alias("p"))
    order = Window.partitionBy("q").orderBy(F.desc("p"), "i")
    total = total.withColumn("position", F.row_number().over(order))
    if k is not None:
        total = total.filter(F.col("position") <= k)
    return total.select(F.col("q").alias(query), F.col("i").alias(item), F.col("p").cast("double").alias("points"), "position")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of each query."""
    hits = table(spark, sf_dir, "chunk_hits").select("query_id", "list_name", "chunk_id", "score")
    return borda(hits, k=5).select("query_id", "chunk_id")


P4_SQL = """
WITH best AS (
  SELECT query_id, list_name, chunk_id, max(score) AS s FROM chunk_hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND chunk_id IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id, list_name) AS n,
    rank() OVER (PARTITION BY query_id, list_name ORDER BY s DESC)
      + (count(*) OVER (PARTITION BY query_id, list_name, s) - 1) / 2.0 AS r FROM best),
total AS (
  SELECT query_id, chunk_id, sum(CAST(round((n - r + 1) / n, 9) AS DECIMAL(24, 9))) AS p FROM ranked GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, chunk_id) AS position FROM total)
SELECT query_id, chunk_id FROM o WHERE position <= 5
"""

QUERIES = {"p4_found": p4_found}
SQL = {"p4_found": P4_SQL}
