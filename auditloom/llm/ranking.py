"""Problem 6: one ranking of several scores by outranking net flows.

Every score is turned into percentiles. An item is preferred to another on a score by a preference function of the difference d of their percentiles: 0 up to
the indifference threshold q, 1 from the preference threshold p on, linear between. Its net flow is the mean over all others of preference for it
minus preference against it. With C and S, the number of rows up to a percentile and the sum of their percentiles, the preference for percentile u is
C(u - p) + ((u - q) (C(u - q) - C(u - p)) - (S(u - q) - S(u - p))) / (p - q), and that against it likewise: C and S at four places come from prefix sums over the sorted
distinct values and places, so the flow is exact without comparing pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import cut_lineage

#: The scores of a membership audit; -1: lower values speak for a member.
MEMBERSHIP = {"ref_ratio": -1, "loss_ft": -1, "text_nb_gap_ft": 1, "clip_img_text_sim": 1}


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def _prefix(values: DataFrame, order: list[str], sums: list[str], buckets: int) -> DataFrame:
    """Sums over all rows of the same score before each row, in order. Each window covers one range of values.

    The ranges are cut at approximate quantiles of the (distinct) values, so they hold about equally many and no task
    sees a whole score; their totals (scores x ranges rows) are added in front.
    """
    cuts = values.groupBy("score").agg(F.percentile_approx("value", [k / buckets for k in range(1, buckets)], 10_000).alias("__cuts")) if buckets > 1 else None
    ranged = values.join(F.broadcast(cuts), "score").withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("value")))).drop("__cuts") if cuts is not None else values.withColumn("__r", F.lit(0))
    totals = ranged.groupBy("score", "__r").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    front = Window.partitionBy("score").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("score", "__r", *[F.coalesce(F.sum(f"__t_{s}").over(front), F.lit(0)).alias(f"__f_{s}") for s in sums])
    inside = Window.partitionBy("score", "__r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(totals), ["score", "__r"])
    return joined.select(*values.columns, *[(F.col(f"__f_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums])


def shifted_sums(values: DataFrame, shifts: dict[str, float], buckets: int) -> DataFrame:
    """(score, value, rows, u, c_<name>, s_<name> ...): rows with a percentile up to u + shift, and the sum of their percentiles; values: (score, value, rows, u)."""
    data = values.select("score", F.col("u").alias("value"), F.lit(0).alias("__q"), "rows", (F.col("u") * F.col("rows")).alias("ux"), F.lit(None).cast("double").alias("__v"))
    places = F.array(*[F.struct(F.lit(i + 1).alias("q"), (F.col("u") + d).alias("at")) for i, d in enumerate(shifts.values())])
    asked = values.select("score", F.explode(places).alias("x"), F.col("value").alias("__v")).select("score", F.col("x.at").alias("value"), F.col("x.q").alias("__q"), F.lit(0).cast("bigint").alias("rows"), F.lit(0.0).alias("ux"), "__v")
    told = _prefix(data.unionByName(asked), ["value", "__q"], ["rows", "ux"], buckets).where("__q > 0")
    at = lambda i, c: F.max(F.when(F.col("__q") == i + 1, F.col(f"before_{c}")))
    wide = told.groupBy("score", F.col("__v").alias("value")).agg(*[at(i, c).alias(f"{p}_{n}") for i, n in enumerate(shifts) for p, c in (("c", "rows"), ("s", "ux"))])
    return values.join(wide, ["score", "value"])


def net_flows(df: DataFrame, key: str, scores: dict[str, int], rows_per_range: int = 500_000, indifference: float = 0.0, preference: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, flow_<score> ..., flow DOUBLE, n BIGINT) of the rows whose scores are all present and finite.

    df has one row a key. Equal values have equal percentiles (mean rank). flow is the weighted mean of the scores' flows (equal weights unless given), from -1 to 1; with
    the defaults preference is the full difference and flow lies within half of that. 0 if there is but one row; no rows come from an empty table. Values are
    counted before they are shuffled, so a value that a third of all rows share is one row; the flows of such values go back by broadcast (there are at
    most ``scores * 1000`` of them), those of the others by a join.
    """
    if not 0 <= indifference < preference:
        raise ValueError("0 <= indifference < preference")
    weight = {s: 1.0 for s in scores} if weights is None else weights
    own = df.select(key, *[(F.col(s).cast("double") * sign + F.lit(0.0)).alias(s) for s, sign in scores.items()]).where(reduce(lambda a, b: a & b, [finite(s) for s in scores]))
    own = cut_lineage(own)  # read three times: to be counted, for the values and for the keys
    n = own.count()
    if n == 0:
        return own.select(key, *[F.lit(0.0).alias(f"flow_{s}") for s in scores], F.lit(0.0).alias("flow"), F.lit(0).cast("long").alias("n"))
    long = own.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in scores])).alias("x")).select(key, "x.*")
    counted = long.groupBy("score", "value").agg(F.count("*").alias("rows"))
    ranges = max(1, -(-n // rows_per_range))
    ranked = _prefix(counted, ["value"], ["rows"], ranges)
    percentile = (F.col("before_rows") + (F.col("rows") - 1) / 2.0) / max(1, n - 1)
    values = cut_lineage(ranked.select("score", "value", "rows", percentile.alias("u")))
    q, p = indifference, preference
    sums = shifted_sums(values, {"far_below": -p, "below": -q, "above": q, "far_above": p}, 5 * ranges)
    c, t, u = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"s_{x}")), F.col("u")
    better = c("far_below") + ((u - q) * (c("below") - c("far_below")) - (t("below") - t("far_below"))) / (p - q)
    worse = (n - c("far_above")) + ((t("far_above") - t("above")) - (u + q) * (c("far_above") - c("above"))) / (p - q)
    flows = sums.select("score", "value", "rows", ((better - worse) / max(1, n - 1)).alias("flow"))
    hot = F.broadcast(flows.where(F.col("rows") > max(1, n // 1000)).select("score", "value", F.col("flow").alias("hot_flow")))
    cold = flows.where(F.col("rows") <= max(1, n // 1000)).select("score", "value", F.col("flow").alias("cold_flow"))
    placed = long.join(hot, ["score", "value"], "left")
    # a hot row takes part in the second join with its key as score: it finds nothing there and isn't gathered in one task
    placed = placed.withColumn("__s", F.when(F.col("hot_flow").isNull(), F.col("score")).otherwise(F.col(key).cast("string")))
    placed = placed.join(cold.withColumnRenamed("score", "__s"), ["__s", "value"], "left")
    one = F.coalesce("hot_flow", "cold_flow")
    wide = placed.groupBy(key).agg(*[F.max(F.when(F.col("score") == s, one)).alias(f"flow_{s}") for s in scores])
    mean = reduce(lambda a, b: a + b, [F.col(f"flow_{s}") * weight[s] for s in scores]) / sum(weight[s] for s in scores)
    return wide.withColumn("flow", mean).withColumn("n", F.lit(n).cast("long"))


#: Rows that are put in order in one task.
ORDERED = 200_000


def top_share(flows: DataFrame, key: str, share: int = 20, ordered: int = ORDERED) -> DataFrame:
    """The keys of the first n // share places, by flow, then by key; a report of top places, so it is limited.

    The range of flows that holds the last place is found by counts over 4,096 ranges, again and again until it has few rows; only these are put in order. What lies above comes whole, from all tasks.
    """
    own = cut_lineage(flows.select(key, "n", F.round("flow", 12).alias("__f")))
    row = own.select("n").first()
    left, low, high = (row["n"] // share if row else 0), -1.001, 1.001
    size = row["n"] if row else 0
    while size > ordered and high - low > 1e-12:
        width = (high - low) / 4096
        within = own.where((F.col("__f") >= low) & (F.col("__f") < high))
        counts = {r[0]: r[1] for r in within.groupBy(F.least(F.lit(4095), F.floor((F.col("__f") - low) / width).cast("int"))).count().collect()}
        for k in range(4095, -1, -1):
            if left <= counts.get(k, 0):
                break
            left -= counts.get(k, 0)
        low, high, size = low + k * width, low + (k + 1) * width if k < 4095 else high, counts.get(k, 0)
    last = own.where((F.col("__f") >= low) & (F.col("__f") < high)).orderBy(F.desc("__f"), key).limit(left)
    return own.where(F.col("__f") >= high).select(key).unionByName(last.select(key))
