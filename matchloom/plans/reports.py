"""Reports over answers and gold: profiles, cross-fitted scores, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import fold
from ..functions.text import has_non_latin
from ..operators import blends, decide, folds, metrics


def match_counts(gold: DataFrame, dimension: DataFrame) -> DataFrame:
    """How many primary records have how many matches."""
    n = dimension.select("s1_id").join(gold.groupBy("s1_id").agg(F.count("*").alias("n_match")), "s1_id", "left").fillna(0, ["n_match"])
    return n.groupBy("n_match").agg(F.count("*").alias("n_s1"))


def one_to_one_violations(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pool_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations"))


def profile(records: DataFrame) -> DataFrame:
    """Per source and country: rows, shares of empty addresses and of names in other scripts."""
    share = lambda c: F.avg(c.cast("double"))
    return records.groupBy("source", "country").agg(F.count("*").alias("n"), share(F.col("business_address") == "").alias("empty_address"), share(has_non_latin(F.col("business_name"))).alias("non_latin"))


def distinct_counts(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """How many different values each column has, in all or for each value of a key; rows too."""
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def same_country(gold: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    pairs = gold.join(s1.select("s1_id", F.col("country").alias("a")), "s1_id").join(pool.select("pool_id", F.col("country").alias("b")), "pool_id")
    return pairs.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("same_country"), F.count("*").alias("n"))


def cross_fitted(pairs: DataFrame, gold: DataFrame, dimension: DataFrame, grid=decide.FAST_GRID, score: str = "prob", key: str = "country") -> DataFrame:
    """Macro F0.5 per key where each half of fold 0 is decided with the other half's best setting."""
    parts = None
    halves = [0, 5]
    cut = lambda df, h: df.where(fold(F.col("s1_id"), 10) == h)
    for a, b in (halves, halves[::-1]):
        best = decide.best_setting(decide.tune(cut(pairs, a), cut(gold, a), cut(dimension, a), grid, (True,), score)).first()
        params = decide.Params(best["method"], best["t"] or 0.0, best["r"] or 0.0, best["alpha"] or 0.0, True)
        scored = metrics.f05_by_entity(decide.decide(cut(pairs, b), params, score), cut(gold, b), cut(dimension, b))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts.groupBy(key).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n"))


def rules_compared(pairs: DataFrame, gold: DataFrame, dimension: DataFrame, alpha: float = 1.5) -> DataFrame:
    """Macro F0.5 of the approximate and the exact expected-score rule."""
    out = None
    for rule in ("expf", "exact"):
        one = metrics.f05_by_entity(decide.decide(pairs, decide.Params(rule, alpha=alpha)), gold, dimension).agg(F.lit(rule).alias("rule"), F.avg("f05").alias("macro_f05"))
        out = one if out is None else out.union(one)
    return out


def assignment_sweep(pairs: DataFrame, pred: DataFrame, gold: DataFrame, dimension: DataFrame, ts=(1.01, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)) -> DataFrame:
    out = None
    for t in ts:
        more = blends.assign_empty_address(pairs, pred, t)
        one = metrics.f05_by_entity(more, gold, dimension).agg(F.lit(float(t)).alias("t"), F.avg("f05").alias("macro_f05"))
        out = one if out is None else out.union(one)
    return out


def shift_sweep(pairs: DataFrame, gold: DataFrame, dimension: DataFrame, country: str, shifts=(-2.0, -1.5, -1.0, -0.5, 0.0, 0.5), alpha: float = 1.5) -> DataFrame:
    out = None
    for d, moved in blends.shift_variants(pairs, dimension, f"{country}:{','.join(map(str, shifts))}").items():
        one = metrics.f05_by_entity(decide.decide(moved, decide.Params(alpha=alpha)), gold, dimension).agg(F.lit(d).alias("shift"), F.avg("f05").alias("macro_f05"))
        out = one if out is None else out.union(one)
    return out


def learning_samples(dimension: DataFrame, shares=(0.125, 0.25, 0.5, 1.0)) -> dict[float, DataFrame]:
    """Nested samples for a learning curve."""
    return {s: folds.fraction(dimension, s) for s in shares}


def error_examples(kinds: DataFrame, kind: str, n: int = 8) -> DataFrame:
    return folds.sample(kinds.where(F.col("kind") == kind), n)
