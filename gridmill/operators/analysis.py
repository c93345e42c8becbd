"""Ranks, correlations, bounded histories, budgets and trace roll-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cut points of a column: a range between two holds about one in CUTS rows, a cut point itself any number.
CUTS = 255


def cut_points(df: DataFrame, column: str) -> list[float]:
    """At most CUTS values that part a column's values evenly (nulls and NaN aside)."""
    return sorted(set(df.stat.approxQuantile(column, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 0.002)))


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """Twice the number of cut points below a value, and one more if it is a cut point itself.

    Buckets are in the order of the values, and those of odd numbers hold one value each, so a value that many rows share
    is no large range.
    """
    listed = F.array(*map(F.lit, cuts)).cast("array<double>")
    return (2 * F.size(F.filter(listed, lambda c: c < value)) + F.array_contains(listed, value.cast("double")).cast("int")).cast("int")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the mean rank of equal values (numbers); rows without a value are left out.

    Ranked over distinct values, in ranges that each add the rows of all ranges before: no task sorts all values.
    """
    cuts = cut_points(df, column)
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c")).withColumn("__b", bucket_of(F.col(column), cuts))
    sizes = values.groupBy("__b").agg(F.sum("__c").alias("__n"))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over 2 * CUTS + 1 rows at most
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0)) + (F.col("__c") + 1) / 2
    ranks = values.join(F.broadcast(before), "__b").select(F.col(column).alias("__v"), rank.alias(name))
    return df.join(ranks, df[column] == ranks["__v"]).drop("__v")


def pearson(x, y):
    """Of population moments; 0 where either does not vary or there are fewer than two rows."""
    return F.round(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)), 6)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """pearson, spearman, kendall in one row; rows that lack either value are left out."""
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, x, "__rx"), y, "__ry")
    two = ranked.agg(pearson(F.col(x), F.col(y)).alias("pearson"), pearson(F.col("__rx"), F.col("__ry")).alias("spearman"))
    return two.join(kendall(both, x, y))  # of one row each


def concordant(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs of points in which both coordinates rise; in n log(n) log(distinct v) steps."""
    order = np.lexsort((-v, u))  # of equal u the larger v come first, so that they never count
    _, rank = np.unique(v, return_inverse=True)
    rank, weight = rank[order], weight[order].astype(np.int64)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (bit + 1)
        at = np.argsort(group, kind="stable")
        low = (rank[at] >> bit) & 1 == 0
        ahead = np.cumsum(np.where(low, weight[at], 0))
        begins = np.concatenate(([True], group[at][1:] != group[at][:-1]))
        base = np.maximum.accumulate(np.where(begins, ahead - np.where(low, weight[at], 0), 0))
        total += int(((ahead - base) * weight[at])[~low].sum())
    return total


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b in one row, exactly.

    Points are dealt into ranges of x and of y (``bucket_of``).  Of two points in different ranges of both, the ranges
    tell whether both coordinates rise: counted on the grid of ranges.  Points that share a range of x, then those that
    share one of y only, are counted range by range.  All other kinds of pairs follow from the sizes of ties.
    """
    points = df.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    points = points.withColumns({"bx": bucket_of(F.col("x"), cut_points(df, x)), "by": bucket_of(F.col("y"), cut_points(df, y))})
    big = "decimal(38,0)"
    pairs = lambda n: n.cast(big) * (n - 1).cast(big) / 2
    tied = lambda name: points.groupBy(name).agg(F.sum("c").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0)).alias(f"tie_{name}"))
    whole = points.agg(F.coalesce(F.sum(pairs(F.col("c"))), F.lit(0)).alias("tie_both"), F.coalesce(pairs(F.sum("c")), F.lit(0)).alias("every"))
    side = lambda name: points.select(F.col(name)).distinct()
    grid = side("bx").join(side("by"))  # (2 * CUTS + 1)^2 rows at most
    held = grid.join(points.groupBy("bx", "by").agg(F.sum("c").alias("n")), ["bx", "by"], "left").na.fill({"n": 0})
    up = held.withColumn("up", F.coalesce(F.sum("n").over(Window.partitionBy("bx").orderBy(F.col("by").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    beyond = up.withColumn("beyond", F.coalesce(F.sum("up").over(Window.partitionBy("by").orderBy(F.col("bx").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    apart = beyond.agg(F.coalesce(F.sum(F.col("n").cast(big) * F.col("beyond").cast(big)), F.lit(0)).alias("apart"))

    def counted(first: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [concordant(group[first].to_numpy(), group["y"].to_numpy(), group["c"].to_numpy())]})

        return run

    near = lambda by, first: points.where(F.col(by) % 2 == 0).groupBy(by).applyInPandas(counted(first), "n long").agg(F.coalesce(F.sum(F.col("n").cast(big)), F.lit(0)).alias(f"near_{by}"))
    one = whole.join(tied("x")).join(tied("y")).join(apart).join(near("bx", "x")).join(near("by", "bx"))  # rows of one line each
    d = lambda name: F.col(name).cast("double")
    rise = d("apart") + d("near_bx") + d("near_by")
    fall = d("every") - d("tie_x") - d("tie_y") + d("tie_both") - rise
    base = F.sqrt(d("every") - d("tie_x")) * F.sqrt(d("every") - d("tie_y"))
    return one.select(F.round(F.coalesce(F.try_divide(rise - fall, base), F.lit(0.0)), 6).alias("kendall"))


def last_entries(df: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The last ``limit`` rows of each key."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def latest_values(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Upsert: the last value of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


RESOURCES = ("model_calls", "schema_attempts", "filling_attempts", "candidates")


def over_budget(steps: DataFrame, limits: dict[str, float]) -> DataFrame:
    """request_id, seq, resource, used of the first step at which a running use is above its limit.

    ``limits``: of model_calls, schema_attempts, filling_attempts, candidates, elapsed_seconds; one that is missing or
    negative is off.  Of several at one step the first in this order is told.  ``steps``: request_id, ts, seq, action, value
    (seconds).
    """
    run = Window.partitionBy("request_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda *names: F.col("action").isin(*names).cast("int")
    use = {"model_calls": 1 - is_("select"), "schema_attempts": is_("schema_attempt"), "filling_attempts": is_("ordinary"), "candidates": is_("ordinary", "transformation"), "elapsed_seconds": F.col("value")}
    on = [k for k in (*RESOURCES, "elapsed_seconds") if limits.get(k, -1) >= 0]
    used = steps.withColumns({f"__{k}": F.sum(use[k]).over(run) for k in on})
    over = [F.when(F.col(f"__{k}") > limits[k], F.struct(F.lit(k).alias("resource"), F.col(f"__{k}").cast("double").alias("used"))) for k in on]
    none = F.lit(None).cast("struct<resource:string,used:double>")
    hit = used.withColumn("__over", F.coalesce(*over, none)).where("__over IS NOT NULL")
    first = hit.groupBy("request_id").agg(F.min(F.struct("ts", "seq", "__over")).alias("f"))
    return first.select("request_id", F.col("f.seq").alias("seq"), F.col("f.__over.resource").alias("resource"), F.round("f.__over.used", 4).alias("used"))


def trace_summary(steps: DataFrame) -> DataFrame:
    """One row over all requests: partial aggregates by request first."""
    count = lambda *names: F.count_if(F.col("action").isin(*names))
    one = steps.groupBy("request_id").agg(
        F.bool_or(F.col("action") == "select").alias("ok"),
        count("ordinary").alias("ordinary"),
        count("transformation").alias("transformed"),
        count("schema_attempt").alias("schema"),
        F.count_if(F.col("action") != "select").alias("calls"),
        F.sum("value").alias("elapsed"),
    )
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)) + 1e-9, 4)
    return one.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        mean(F.col("ok").cast("int")).alias("success_rate"),
        F.coalesce(F.sum(F.col("ordinary") + F.col("transformed")), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("ordinary"), F.lit(0)).alias("ordinary_candidates"),
        F.coalesce(F.sum("transformed"), F.lit(0)).alias("transformed_candidates"),
        mean(F.col("ordinary") + F.col("transformed")).alias("average_candidates"),
        mean("calls").alias("average_model_calls"),
        mean("elapsed").alias("average_elapsed_seconds"),
        mean("ordinary").alias("average_filling_attempts"),
        mean("schema").alias("average_schema_attempts"),
    )


def counters(steps: DataFrame) -> DataFrame:
    """kind, name, n: actions, transformations, sources and rejection reasons counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("action", "transformation", "source", "rejection_reason")])
    return steps.select(F.inline(pairs)).where("name IS NOT NULL AND name <> ''").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
