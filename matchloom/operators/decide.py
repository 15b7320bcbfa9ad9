"""From scored pairs to matches: one-to-one, thresholds, expected F0.5, and the search for their parameters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .metrics import f05_column


@dataclass(frozen=True)
class Params:
    """method: thresh (t, r), expf or exact (alpha)."""

    method: str = "expf"
    t: float = 0.5
    r: float = 0.0
    alpha: float = 1.5
    one_to_one: bool = True


THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(18)]
FULL_GRID = [Params("thresh", t, r) for t in THRESHOLDS for r in (0.0, 0.2, 0.4, 0.6)] + [Params("expf", alpha=a) for a in (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)]
FAST_GRID = [Params("expf", alpha=a) for a in (1.0, 1.5, 2.0, 3.0, 5.0)]


def one_to_one(pairs: DataFrame, score: str = "prob") -> DataFrame:
    """Each pool record stays with its best primary record only (ties: the smaller s1_id)."""
    best = W.partitionBy("pool_id").orderBy(F.desc(score), "s1_id")
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def choose_thresh(pairs: DataFrame, t: float, r: float, score: str = "prob") -> DataFrame:
    best = F.max(score).over(W.partitionBy("s1_id"))
    return pairs.withColumn("_b", best).where((F.col("_b") >= t) & (F.col(score) >= t) & (F.col(score) >= r * F.col("_b"))).drop("_b")


def expected_prefixes(pairs: DataFrame, score: str = "prob") -> DataFrame:
    """Adds k (place in its group), e_k (expected F0.5 of the first k) and none (chance that nothing matches)."""
    group = W.partitionBy("s1_id")
    order = group.orderBy(F.desc(score), "pool_id")
    df = pairs.withColumn("k", F.row_number().over(order)).withColumn("_c", F.sum(score).over(order.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_s", F.sum(score).over(group)).withColumn("none", F.product(1 - F.col(score)).over(group))
    return df.withColumn("e_k", 1.25 * F.col("_c") / (0.25 * F.col("_s") + F.col("k"))).drop("_c", "_s")


def choose_expf(pairs: DataFrame, alpha: float, score: str = "prob") -> DataFrame:
    """The shortest prefix with the highest expected F0.5; nothing if leaving it empty is expected to be as good."""
    group = W.partitionBy("s1_id")
    df = expected_prefixes(pairs, score).withColumn("_best", F.max("e_k").over(group))
    df = df.withColumn("_k", F.min(F.when(F.col("e_k") == F.col("_best"), F.col("k"))).over(group))
    return df.where((F.col("_best") > alpha * F.col("none")) & (F.col("k") <= F.col("_k"))).drop("k", "e_k", "none", "_best", "_k")


def exact_choice(probs: list[float], alpha: float, longest: int = 15) -> int:
    """Length of the prefix whose exact expected F0.5 is highest; 0 if leaving it empty is expected to be as good.

    The hits of a prefix are a sum over its pairs, so its expected score is one too: pair i adds its own probability
    times the mean of 1.25 / (0.25 g + k), where g - 1 counts the matches among all the others.
    """
    p = np.asarray(probs[:longest], dtype=float)
    n = len(p)
    others = np.zeros((n, n))  # row i: chances of 0, 1, ... matches among all pairs but i
    for i in range(n):
        others[i, 0] = 1.0
        for q in np.delete(p, i):
            others[i, 1:] = others[i, 1:] * (1 - q) + others[i, :-1] * q
            others[i, 0] *= 1 - q
    gold, length = np.arange(1, n + 1), np.arange(1, n + 1)
    adds = p[:, None] * (others @ (1.25 / (0.25 * gold[:, None] + length[None, :])))  # of pair i in a prefix of length k
    expected = np.array([alpha * float(np.prod(1 - p)), *(adds[:k, k - 1].sum() for k in length)])
    return int(expected.argmax())


def choose_exact(pairs: DataFrame, alpha: float, score: str = "prob", longest: int = 15) -> DataFrame:
    """As choose_expf, with the exact expectation over the first `longest` pairs of a group."""
    order = W.partitionBy("s1_id").orderBy(F.desc(score), "pool_id")
    ranked = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= longest)

    @F.pandas_udf("int")
    def length(probs: pd.Series) -> pd.Series:
        return probs.map(lambda p: exact_choice(list(p), alpha, longest))

    lists = ranked.groupBy("s1_id").agg(F.array_sort(F.collect_list(score), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("_p"))
    chosen = lists.select("s1_id", length("_p").alias("_n"))
    return ranked.join(chosen, "s1_id").where("_k <= _n").drop("_k", "_n")


def decide(pairs: DataFrame, params: Params, score: str = "prob") -> DataFrame:
    """Matched pairs; a primary record without any is simply absent."""
    work = one_to_one(pairs, score) if params.one_to_one else pairs
    if params.method == "thresh":
        return choose_thresh(work, params.t, params.r, score)
    return (choose_expf if params.method == "expf" else choose_exact)(work, params.alpha, score)


def match_lists(matches: DataFrame, dimension: DataFrame, score: str = "prob") -> DataFrame:
    """s1_id and its matches, best first, for every primary record."""
    lists = matches.groupBy("s1_id").agg(F.sort_array(F.collect_list(F.struct(F.negative(score).alias("p"), "pool_id"))).alias("m"))
    return dimension.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce(F.transform("m", lambda x: x["pool_id"]), F.array()).alias("matches"))


def tune(pairs: DataFrame, gold: DataFrame, dimension: DataFrame, grid=FULL_GRID, one_to_one_options=(True, False), score: str = "prob") -> DataFrame:
    """Macro F0.5 of every setting: place (order of trial), method, t, r, alpha, one_to_one, macro_f05.

    Thresholds are explode-and-count over the pairs that pass; the best prefix of expf does not depend on alpha, so
    each record is cut once and alphas only choose between it and nothing.
    """
    labelled = pairs.select("s1_id", "pool_id", F.col(score).alias("prob")).join(gold.select("s1_id", "pool_id", F.lit(1).alias("y")), ["s1_id", "pool_id"], "left").fillna(0, ["y"])
    n_gold = dimension.select("s1_id").join(gold.groupBy("s1_id").agg(F.count("*").alias("ng")), "s1_id", "left").fillna(0, ["ng"])
    spark, parts, place = pairs.sparkSession, [], 0
    for o2o in one_to_one_options:
        work = one_to_one(labelled, "prob") if o2o else labelled
        thresh = [(place + i, p.t, p.r) for i, p in enumerate(grid) if p.method == "thresh"]
        expf = [(place + i, p.alpha) for i, p in enumerate(grid) if p.method == "expf"]
        if thresh:
            settings = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("t"), F.lit(r).alias("r")) for i, t, r in thresh])
            best = work.withColumn("b", F.max("prob").over(W.partitionBy("s1_id")))
            passed = best.select("s1_id", "y", F.explode(F.filter(settings, lambda s: (F.col("prob") >= s["t"]) & (F.col("prob") >= s["r"] * F.col("b")))).alias("s"))
            parts.append(passed.groupBy("s1_id", F.col("s.place").alias("place")).agg(F.count("*").alias("np"), F.sum("y").alias("tp")))
        if expf:
            cut = expected_prefixes(work).withColumn("best", F.max("e_k").over(W.partitionBy("s1_id")))
            cut = cut.withColumn("kk", F.min(F.when(F.col("e_k") == F.col("best"), F.col("k"))).over(W.partitionBy("s1_id"))).where("k <= kk")
            one = cut.groupBy("s1_id").agg(F.count("*").alias("np"), F.sum("y").alias("tp"), F.max("best").alias("best"), F.max("none").alias("none"))
            alphas = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(float(a)).alias("alpha")) for i, a in expf])
            parts.append(one.select("s1_id", F.explode(F.filter(alphas, lambda a: F.col("best") > a["alpha"] * F.col("none"))).alias("a"), "np", "tp").select("s1_id", F.col("a.place").alias("place"), "np", "tp"))
        place += len(grid)
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    scored = counts.join(n_gold, "s1_id").withColumn("f", f05_column(F.col("np"), F.col("ng"), F.col("tp")))
    # Records for which a setting says nothing score 1 if they have no gold, else 0.
    gained = scored.groupBy("place").agg(F.sum("f").alias("f"), F.sum((F.col("ng") == 0).cast("int")).alias("spoilt"))
    total = n_gold.agg(F.count("*").alias("n"), F.sum((F.col("ng") == 0).cast("int")).alias("alone"))
    rows = [(i, p.method, p.t if p.method == "thresh" else None, p.r if p.method == "thresh" else None, None if p.method == "thresh" else p.alpha, o) for i, (o, p) in enumerate((o, p) for o in one_to_one_options for p in grid)]
    names = spark.createDataFrame(rows, "place int, method string, t double, r double, alpha double, one_to_one boolean")
    out = F.broadcast(names).join(gained, "place", "left").crossJoin(F.broadcast(total))  # two tables of a grid's size and of one row
    macro = (F.coalesce("f", F.lit(0.0)) + F.col("alone") - F.coalesce("spoilt", F.lit(0))) / F.col("n")
    return out.select(*names.columns, macro.alias("macro_f05"))


def best_setting(tuned: DataFrame) -> DataFrame:
    """The setting with the highest score to twelve digits, the first tried of equals."""
    return tuned.agg(F.max_by(F.struct(*tuned.columns), F.struct(F.round("macro_f05", 12), -F.col("place"))).alias("b")).select("b.*")
