"""Scores of matches against gold pairs. All start from the table of primary records, so that empty answers count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05_column(n_pred: Column, n_gold: Column, hits: Column) -> Column:
    return F.when(n_gold == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(hits == 0, 0.0).otherwise(1.25 * hits / (0.25 * n_gold + n_pred))


def entity_counts(pred: DataFrame, gold: DataFrame, dimension: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """dimension's rows with n_pred, n_gold, hits and, given cands, gold_in_cands: one union, one aggregate, one join."""
    mark = lambda df, name: df.select("s1_id", "pool_id", F.lit(name).alias("kind"))
    rows = mark(pred, "p").union(mark(gold, "g"))
    if cands is not None:
        rows = rows.union(mark(cands, "c"))
    has = lambda k: F.max((F.col("kind") == k).cast("int")).alias(k)
    pair = rows.groupBy("s1_id", "pool_id").agg(has("p"), has("g"), has("c"))
    per = pair.groupBy("s1_id").agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.col("p") * F.col("g")).alias("hits"), F.sum(F.col("c") * F.col("g")).alias("gold_in_cands"))
    return dimension.join(per, "s1_id", "left").fillna(0, ["n_pred", "n_gold", "hits", "gold_in_cands"])


def f05_by_entity(pred: DataFrame, gold: DataFrame, dimension: DataFrame) -> DataFrame:
    return entity_counts(pred, gold, dimension).withColumn("f05", f05_column(F.col("n_pred"), F.col("n_gold"), F.col("hits"))).drop("gold_in_cands")


def score_by(pred: DataFrame, gold: DataFrame, dimension: DataFrame, key: str | Column) -> DataFrame:
    scored = f05_by_entity(pred, gold, dimension)
    key = F.col(key) if isinstance(key, str) else key
    return scored.groupBy(key).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n"))


def blocking_recall(cands: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold pairs among the candidates."""
    found = gold.select("s1_id", "pool_id").join(cands.select("s1_id", "pool_id", F.lit(1).alias("hit")).distinct(), ["s1_id", "pool_id"], "left")
    return found.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("recall"), F.count("*").alias("n_gold"))


def recall_at(cands: DataFrame, rank: str, gold: DataFrame, ks=(5, 10, 20, 30, 50)) -> DataFrame:
    found = gold.select("s1_id", "pool_id").join(cands.select("s1_id", "pool_id", F.col(rank).alias("_r")), ["s1_id", "pool_id"], "left")
    hits = found.agg(F.count("*").alias("n"), *[F.sum(F.coalesce((F.col("_r") <= k).cast("int"), F.lit(0))).alias(f"k{k}") for k in ks])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(F.col(f"k{k}"), F.lit(0)) / F.greatest("n", F.lit(1))).alias("recall")) for k in ks]))
    return hits.select(each.alias("x")).select("x.*")


def oracle_f05(cands: DataFrame, gold: DataFrame, dimension: DataFrame) -> DataFrame:
    """Macro F0.5 of a matcher that keeps just the right candidates."""
    right = cands.select("s1_id", "pool_id").join(gold.select("s1_id", "pool_id"), ["s1_id", "pool_id"], "left_semi").distinct()
    return f05_by_entity(right, gold, dimension).agg(F.avg("f05").alias("oracle_f05"))


def loss_kinds(pred: DataFrame, gold: DataFrame, dimension: DataFrame, cands: DataFrame) -> DataFrame:
    """Each primary record with the kind of its error and the score it loses."""
    c = entity_counts(pred, gold, dimension, cands)
    p, g, h = F.col("n_pred"), F.col("n_gold"), F.col("hits")
    missed = g - F.col("gold_in_cands")
    kind = (
        F.when(g == 0, F.when(p > 0, "singleton_fp").otherwise("ok"))
        .when(p == 0, F.when(missed == g, "empty_pred_blocking").otherwise("empty_pred"))
        .when(h == 0, "all_wrong")
        .when((p > h) & (g > h), "fp_and_fn")
        .when(p > h, "extra_fp")
        .when(g > h, F.when(missed == g - h, "missed_blocking").otherwise("missed_ranked"))
        .otherwise("ok")
    )
    return c.withColumn("kind", kind).withColumn("loss", 1 - f05_column(p, g, h)).withColumn("miss_block", missed)


def loss_decomposition(kinds: DataFrame, key: str = "country") -> DataFrame:
    """Per key and kind: count, loss, and the part of the macro score that it costs (the parts add up to 1 - macro)."""
    n = kinds.agg(F.count("*").alias("_n"))
    grouped = kinds.where("kind <> 'ok'").groupBy(key, "kind").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))
    return grouped.crossJoin(F.broadcast(n)).select(key, "kind", "n", "loss", (F.col("loss") / F.col("_n")).alias("points_lost"))


def error_accounting(kinds: DataFrame) -> DataFrame:
    """Counts of pairs: hits, false ones (those on singletons apart), missed ones (in blocking, or rejected)."""
    p, g, h = F.col("n_pred"), F.col("n_gold"), F.col("hits")
    out = kinds.agg(
        F.sum(h).alias("tp"),
        F.sum(p - h).alias("fp"),
        F.sum(F.when(g == 0, p).otherwise(0)).alias("fp_singleton"),
        F.sum(g - h).alias("fn"),
        F.sum("miss_block").alias("fn_blocking"),
        F.sum(g - h - F.col("miss_block")).alias("fn_rejected"),
    )
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def auc(df: DataFrame, score: str, label: str, by: str | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums with ties shared, and log loss, overall or for each key.

    Scores are counted by value first. Values are then numbered within slices of the logit, of which there are a few
    thousand whatever the table's size: negatives of lower slices, then those below in the same slice.
    """
    from pyspark.sql import Window as W

    keys = [by] if by else []
    counts = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    q = F.least(F.greatest(F.col("_s"), F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = counts.withColumn("_slice", F.floor(64 * F.ln(q / (1 - q))))
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_all"))
    lower = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*keys, "_slice", F.coalesce(F.sum("_all").over(lower), F.lit(0)).alias("_lower"))
    within = W.partitionBy(*keys, "_slice").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_slice"]]
    placed = counts.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("c").join(slices.alias("s"), on).select("c.*", "_lower")
    return placed.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_p") * (F.col("_lower") + F.col("_in") + F.col("_n") / 2)), F.sum("_p") * F.sum("_n")).alias("auc"),
        (-F.sum(F.col("_p") * F.ln(q) + F.col("_n") * F.ln(1 - q)) / F.sum(F.col("_p") + F.col("_n"))).alias("logloss"),
    )


def submission_diff(a: DataFrame, b: DataFrame, dimension: DataFrame, key: str = "country") -> DataFrame:
    """Two answers (pairs) compared per key: share of records changed, pairs of each, shared, shares left empty."""
    c = entity_counts(a, b, dimension)
    changed = ((F.col("n_pred") != F.col("hits")) | (F.col("n_gold") != F.col("hits"))).cast("double")
    return c.groupBy(key).agg(
        F.count("*").alias("n_s1"), F.avg(changed).alias("changed"), F.sum("n_pred").alias("matches_a"), F.sum("n_gold").alias("matches_b"), F.sum("hits").alias("shared"),
        F.avg((F.col("n_pred") == 0).cast("double")).alias("empty_a"), F.avg((F.col("n_gold") == 0).cast("double")).alias("empty_b"),
    )
