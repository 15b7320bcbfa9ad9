"""Every operator as a query over the driver's tables, with SQL that says the same.

Scored pairs are order-part pairs: a price share stands for the model's score, a discount for a second model's, a
returned line for the label. Orders are the primary records, their customer's nation is the country. Documents stand
for texts, embeddings for vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import similarity as sm
from ..functions import text as tx
from ..operators import blends, blocking, context, decide, features, folds, learn, metrics, validate
from ..sources import sinks, tables
from ..sources.shared import shared_dir, tasks_of, written
from . import reports
from . import text_sql as ts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("pool_id"))
    return lines.agg((F.max("l_extendedprice") / 105000).alias("prob"), (F.max("l_discount") * 9 + 0.05).alias("ce_prob"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))


def dimension_of(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nation, "c_nationkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey").select(F.col("o_orderkey").alias("s1_id"), "country")


def gold_of(pairs: DataFrame) -> DataFrame:
    return pairs.where("label = 1").select("s1_id", "pool_id")


PAIRS = """pairs AS (SELECT l_orderkey AS s1_id, l_partkey AS pool_id, max(l_extendedprice) / 105000 AS prob, max(l_discount) * 9 + 0.05 AS ce_prob,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY ALL)"""
DIM = "dim AS (SELECT o_orderkey AS s1_id, n_name AS country FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"
O2O = "o2o AS (SELECT s1_id, pool_id, prob, label FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY prob DESC, s1_id) AS r FROM pairs) WHERE r = 1)"
EXPF = """px AS (SELECT s1_id, pool_id, prob, label, row_number() OVER o AS k, 1.25 * sum(prob) OVER (o ROWS UNBOUNDED PRECEDING) / (0.25 * sum(prob) OVER g + row_number() OVER o) AS e, product(1 - prob) OVER g AS none
  FROM o2o WINDOW o AS (PARTITION BY s1_id ORDER BY prob DESC, pool_id), g AS (PARTITION BY s1_id)),
bx AS (SELECT *, max(e) OVER (PARTITION BY s1_id) AS best FROM px), kx AS (SELECT *, min(CASE WHEN e = best THEN k END) OVER (PARTITION BY s1_id) AS kk FROM bx),
pred AS (SELECT s1_id, pool_id, prob, label FROM kx WHERE best > 1.5 * none AND k <= kk)"""
F05 = "CASE WHEN ng = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * ng + np) END"
COUNTS = f"""cnt AS (SELECT s1_id, country, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(tp, 0) AS tp FROM dim
  LEFT JOIN (SELECT s1_id, count(*) AS np, sum(label) AS tp FROM pred GROUP BY ALL) USING (s1_id) LEFT JOIN (SELECT s1_id, sum(label) AS ng FROM pairs GROUP BY ALL) USING (s1_id)),
sco AS (SELECT *, {F05} AS f05 FROM cnt)"""
CHAIN = ", ".join([PAIRS, DIM, O2O, EXPF, COUNTS])
R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = pairs_of(spark, d)
    return p, decide.decide(p, decide.Params(alpha=1.5)), dimension_of(spark, d)


# --- decisions and metrics


@query(f"WITH {CHAIN} SELECT country, round(avg(f05), 6) AS macro_f05, count(*) AS n FROM sco GROUP BY country")
def macro_f05_by_country(spark, d):
    p, pred, dim = decided(spark, d)
    return metrics.score_by(pred, gold_of(p), dim, "country").select("country", *R6("macro_f05"), "n")


@query(f"WITH {PAIRS}, {O2O} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM o2o")
def one_to_one(spark, d):
    return decide.one_to_one(pairs_of(spark, d)).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS b FROM pairs) WHERE b >= 0.5 AND prob >= 0.5 AND prob >= 0.6 * b")
def decide_thresh(spark, d):
    return decide.choose_thresh(pairs_of(spark, d), 0.5, 0.6).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {PAIRS}, {O2O}, {EXPF} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM pred")
def decide_expf(spark, d):
    return decide.decide(pairs_of(spark, d), decide.Params(alpha=1.5)).select("s1_id", "pool_id", *R6("prob"))


#: Leave-one-out counts: for each pair, the chances of 0, 1, ... matches among the others of its record.
_EXACT = """ranked AS (SELECT s1_id, pool_id, prob, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, pool_id) AS k FROM o2o), lists AS (SELECT s1_id, list(prob ORDER BY k) AS ps FROM ranked WHERE k <= 15 GROUP BY ALL),
loo AS (SELECT s1_id, unnest(range(1, len(ps) + 1)) AS i, 1 AS m, ps, [1.0::DOUBLE] AS q FROM lists
  UNION ALL SELECT s1_id, i, m + 1, ps, CASE WHEN m = i THEN q ELSE list_transform(range(1, len(q) + 2), lambda j: coalesce(q[j], 0) * (1 - ps[m]) + CASE WHEN j > 1 THEN q[j - 1] * ps[m] ELSE 0 END) END FROM loo WHERE m <= len(ps)),
terms AS (SELECT s1_id, i, ps, q, unnest(range(i, len(ps) + 1)) AS k FROM loo WHERE m > len(ps)),
gains AS (SELECT s1_id, k, sum(ps[i] * list_sum(list_transform(range(1, len(q) + 1), lambda j: q[j] * 1.25 / (0.25 * j + k)))) AS e, any_value(list_product(list_transform(ps, lambda x: 1 - x))) AS none FROM terms GROUP BY s1_id, k),
chosen AS (SELECT s1_id, arg_max(k, (round(e, 12), -k)) AS n FROM gains GROUP BY s1_id HAVING max(e) > 1.5 * any_value(none))"""


@query(f"WITH RECURSIVE {PAIRS}, {O2O}, {_EXACT} SELECT s1_id, pool_id, round(prob, 6) AS prob FROM ranked JOIN chosen USING (s1_id) WHERE k <= n")
def decide_exact(spark, d):
    return decide.decide(pairs_of(spark, d), decide.Params("exact", alpha=1.5)).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {CHAIN} SELECT s1_id, country, np AS n_pred, ng AS n_gold, tp AS hits, round(f05, 6) AS f05 FROM sco")
def f05_by_entity(spark, d):
    p, pred, dim = decided(spark, d)
    return metrics.f05_by_entity(pred, gold_of(p), dim).select("s1_id", "country", "n_pred", "n_gold", "hits", *R6("f05"))


@query(f"WITH {PAIRS}, {DIM}, g AS (SELECT s1_id, sum(label) AS g FROM pairs GROUP BY ALL), c AS (SELECT s1_id, sum(label) AS h FROM pairs WHERE prob >= 0.3 GROUP BY ALL) SELECT round(avg(CASE WHEN coalesce(g, 0) = 0 THEN 1.0 WHEN coalesce(h, 0) = 0 THEN 0.0 ELSE 1.25 * h / (0.25 * g + h) END), 6) AS oracle_f05 FROM dim LEFT JOIN g USING (s1_id) LEFT JOIN c USING (s1_id)")
def oracle_f05(spark, d):
    p = pairs_of(spark, d)
    return metrics.oracle_f05(p.where("prob >= 0.3"), gold_of(p), dimension_of(spark, d)).select(*R6("oracle_f05"))


KINDS = f"""{CHAIN}, blk AS (SELECT s1_id, sum(label) AS gc FROM pairs WHERE prob >= 0.3 GROUP BY ALL),
kinds AS (SELECT sco.*, ng - coalesce(gc, 0) AS miss, 1 - f05 AS loss, CASE WHEN ng = 0 THEN CASE WHEN np > 0 THEN 'singleton_fp' ELSE 'ok' END WHEN np = 0 THEN CASE WHEN ng - coalesce(gc, 0) = ng THEN 'empty_pred_blocking' ELSE 'empty_pred' END
  WHEN tp = 0 THEN 'all_wrong' WHEN np > tp AND ng > tp THEN 'fp_and_fn' WHEN np > tp THEN 'extra_fp' WHEN ng > tp THEN CASE WHEN ng - coalesce(gc, 0) = ng - tp THEN 'missed_blocking' ELSE 'missed_ranked' END ELSE 'ok' END AS kind FROM sco LEFT JOIN blk USING (s1_id))"""


def kinds_of(spark, d):
    p, pred, dim = decided(spark, d)
    return metrics.loss_kinds(pred, gold_of(p), dim, p.where("prob >= 0.3"))


@query(f"WITH {KINDS} SELECT country, kind, count(*) AS n, round(sum(loss), 6) AS loss, round(sum(loss) / (SELECT count(*) FROM kinds), 6) AS points_lost FROM kinds WHERE kind <> 'ok' GROUP BY ALL")
def loss_decomposition(spark, d):
    return metrics.loss_decomposition(kinds_of(spark, d)).select("country", "kind", "n", *R6("loss", "points_lost"))


@query(f"WITH {KINDS} SELECT sum(tp) AS tp, sum(np - tp) AS fp, sum(CASE WHEN ng = 0 THEN np ELSE 0 END) AS fp_singleton, sum(ng - tp) AS fn, sum(miss) AS fn_blocking, sum(ng - tp - miss) AS fn_rejected, round(sum(tp) / sum(np), 6) AS precision, round(sum(tp) / sum(ng), 6) AS recall FROM kinds")
def error_accounting(spark, d):
    return metrics.error_accounting(kinds_of(spark, d)).select("tp", "fp", "fp_singleton", "fn", "fn_blocking", "fn_rejected", *R6("precision", "recall"))


_GRID = " UNION ALL ".join(f"SELECT {i} AS place, '{p.method}' AS method, {p.t if p.method == 'thresh' else 'NULL'} AS t, {p.r if p.method == 'thresh' else 'NULL'} AS r, {'NULL' if p.method == 'thresh' else p.alpha} AS alpha" for i, p in enumerate(decide.FULL_GRID))


def _tune_sql(pairs: str, dimension: str, grid: str, options: str = "true, false") -> str:
    """CTEs up to `tuned` over tables of pairs (s1_id, pool_id, prob, label) and of primary records.

    A record's pairs are one row, in order; its best prefix does not depend on alpha.
    """
    return f"""grid AS ({grid}), opt AS (SELECT unnest([{options}]) AS one_to_one),
marked AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY prob DESC, s1_id) = 1 AS top FROM {pairs}),
lists AS (SELECT one_to_one, s1_id, list(prob ORDER BY prob DESC, pool_id) AS ps, list(label ORDER BY prob DESC, pool_id) AS ls FROM marked JOIN opt ON top OR NOT one_to_one GROUP BY ALL),
golds AS (SELECT {dimension}.s1_id, coalesce(sum(label), 0) AS ng FROM {dimension} LEFT JOIN {pairs} ON {pairs}.s1_id = {dimension}.s1_id GROUP BY ALL),
es AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda k: 1.25 * list_sum(ps[1:k]) / (0.25 * list_sum(ps) + k)) AS e, list_product(list_transform(ps, lambda x: 1 - x)) AS none FROM lists),
bests AS (SELECT *, list_max(e) AS best, list_position(e, list_max(e)) AS kk FROM es),
said AS (SELECT one_to_one, place, s1_id, len(list_filter(ps, lambda x: x >= t AND x >= r * ps[1])) AS np, ls FROM bests, grid WHERE method = 'thresh' AND ps[1] >= t
  UNION ALL SELECT one_to_one, place, s1_id, kk, ls FROM bests, grid WHERE method = 'expf' AND best > alpha * none),
hits AS (SELECT one_to_one, place, s1_id, np, list_sum(ls[1:np]) AS tp FROM said),
sums AS (SELECT one_to_one, place, sum({F05}) AS f, sum(CASE WHEN ng = 0 THEN 1 ELSE 0 END) AS spoilt FROM hits JOIN golds USING (s1_id) GROUP BY ALL),
tuned AS (SELECT grid.*, opt.one_to_one, (coalesce(f, 0) + (SELECT count(*) FROM golds WHERE ng = 0) - coalesce(spoilt, 0)) / (SELECT count(*) FROM golds) AS macro_f05
  FROM grid CROSS JOIN opt LEFT JOIN sums ON sums.place = grid.place AND sums.one_to_one = opt.one_to_one)"""


@query(f"WITH {PAIRS}, {DIM}, {_tune_sql('pairs', 'dim', _GRID)} SELECT method, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r, CAST(alpha AS DOUBLE) AS alpha, one_to_one, round(macro_f05, 6) AS macro_f05 FROM tuned")
def tune_grid(spark, d):
    p = pairs_of(spark, d)
    tuned = decide.tune(p, gold_of(p), dimension_of(spark, d))
    return tuned.select("method", "t", "r", "alpha", "one_to_one", *R6("macro_f05"))


@query(f"WITH {PAIRS}, {DIM}, {_tune_sql('pairs', 'dim', _GRID)} SELECT method, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r, CAST(alpha AS DOUBLE) AS alpha, one_to_one, round(macro_f05, 6) AS macro_f05 FROM tuned ORDER BY round(tuned.macro_f05, 12) DESC, tuned.one_to_one DESC, place LIMIT 1")
def best_setting(spark, d):
    p = pairs_of(spark, d)
    best = decide.best_setting(decide.tune(p, gold_of(p), dimension_of(spark, d)))
    return best.select("method", "t", "r", "alpha", "one_to_one", *R6("macro_f05"))


# --- context


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, rank() OVER (PARTITION BY s1_id ORDER BY prob DESC) AS s1_rank_prob, round(max(prob) OVER (PARTITION BY s1_id) - prob, 6) AS s1_gap_prob FROM pairs")
def s1_context(spark, d):
    return context.rank_and_gap(pairs_of(spark, d), "s1_id", "prob", "s1").select("s1_id", "pool_id", "s1_rank_prob", *R6("s1_gap_prob"))


@query(
    f"""WITH {PAIRS}, a AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY prob DESC) AS r, count(*) OVER (PARTITION BY pool_id) AS n FROM pairs WHERE prob >= 0.2),
f AS (SELECT pool_id, n, max(CASE WHEN r = 1 THEN prob END) AS p1, max(CASE WHEN r = 2 THEN prob END) AS p2 FROM a WHERE r <= 2 GROUP BY ALL),
o AS (SELECT s1_id, pool_id, prob, coalesce(n, 1) AS pool_n, CASE WHEN p1 IS NULL THEN NULL WHEN prob >= p1 THEN coalesce(p2, 0) ELSE p1 END AS other, CASE WHEN prob >= p1 THEN 1 ELSE 0 END AS pool_is_top FROM pairs LEFT JOIN f USING (pool_id))
SELECT s1_id, pool_id, pool_n, round(other, 6) AS pool_best_other, round(prob - other, 6) AS pool_margin, pool_is_top FROM o"""
)
def pool_context(spark, d):
    p = pairs_of(spark, d)
    return context.pool_context(p, p, floor=0.2).select("s1_id", "pool_id", "pool_n", *R6("pool_best_other", "pool_margin"), "pool_is_top")


_CONTEXT = """SELECT s1_id, pool_id, r AS p1_rank, round(max(prob) OVER g, 6) AS p1_max, round(max(prob) OVER g - prob, 6) AS p1_gap, round(sum(prob) OVER g, 6) AS p1_sum, sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) OVER g AS p1_n50,
  round(coalesce(max(CASE WHEN r = 2 THEN prob END) OVER g, 0), 6) AS p1_second FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, pool_id) AS r FROM pairs) WINDOW g AS (PARTITION BY s1_id)"""


@query(f"WITH {PAIRS} {_CONTEXT}")
def prob_context(spark, d):
    out, _ = learn.second_stage(pairs_of(spark, d))
    return out.select("s1_id", "pool_id", "p1_rank", *R6("p1_max", "p1_gap", "p1_sum"), "p1_n50", *R6("p1_second"))


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, count(*) OVER (PARTITION BY s1_id) AS n_cands_s1, count(*) OVER p AS n_s1_per_cand, rank() OVER (PARTITION BY pool_id ORDER BY prob DESC) AS cand_rank_tok_score, round(max(prob) OVER p - prob, 6) AS cand_gap_tok_score FROM pairs WINDOW p AS (PARTITION BY pool_id)")
def global_context(spark, d):
    p = pairs_of(spark, d).withColumnRenamed("prob", "tok_score")
    return context.global_context(p).select("s1_id", "pool_id", "n_cands_s1", "n_s1_per_cand", "cand_rank_tok_score", *R6("cand_gap_tok_score"))


# --- blends

CLIP = lambda c: f"least(greatest({c}, 0.000001), 0.999999)"
LOGIT = lambda c: f"ln({CLIP(c)} / (1 - {CLIP(c)}))"
SIG = lambda z: f"1 / (1 + exp(-({z})))"


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, round({SIG(f'0.5 * {LOGIT("prob")} + 0.5 * {LOGIT("ce_prob")}')}, 6) AS prob FROM pairs WHERE prob >= 0.001")
def logit_blend(spark, d):
    p = pairs_of(spark, d)
    return blends.blend(p.select("s1_id", "pool_id", "prob"), p.select("s1_id", "pool_id", "ce_prob")).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, round(0.3 * prob + 0.7 * ce_prob, 6) AS prob FROM pairs WHERE prob >= 0.001")
def prob_blend(spark, d):
    p = pairs_of(spark, d)
    return blends.blend(p.select("s1_id", "pool_id", "prob"), p.select("s1_id", "pool_id", "ce_prob"), "prob", 0.7).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {PAIRS}, {DIM} SELECT s1_id, pool_id, round(CASE WHEN country = 'NATION_3' THEN {SIG(LOGIT('prob') + ' - 1.25')} ELSE prob END, 6) AS prob FROM pairs LEFT JOIN dim USING (s1_id)")
def shift_scores(spark, d):
    return blends.shift_variants(pairs_of(spark, d), dimension_of(spark, d), "NATION_3:-1.25")[-1.25].select("s1_id", "pool_id", *R6("prob"))


_FILL = f"{SIG(f'0.5 * {LOGIT("prob")} + 0.5 * {LOGIT("ce_prob")}')}"


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, round(CASE WHEN label = 1 AND {_FILL} BETWEEN 0.2 AND 0.8 THEN prob * prob ELSE ce_prob END, 6) AS xl_prob FROM pairs")
def fill_scores(spark, d):
    p = pairs_of(spark, d).withColumn("lgbm_prob", F.col("prob")).withColumn("xl_prob", F.when(F.col("label") == 1, F.col("prob") * F.col("prob")))
    return blends.fill(p, ["xl=ce:0.2:0.8"]).select("s1_id", "pool_id", *R6("xl_prob"))


def _unseen(spark, d):
    dim = dimension_of(spark, d)
    return blends.unseen_entities(dim, dim.where("country < 'NATION_2'"))


_UNSEEN = "unseen AS (SELECT s1_id FROM dim WHERE country NOT IN (SELECT country FROM dim WHERE country < 'NATION_2'))"


@query(f"WITH {PAIRS}, {DIM}, {_UNSEEN} SELECT s1_id, pool_id, round(CASE WHEN s1_id IN (SELECT s1_id FROM unseen) AND label = 1 THEN prob / 2 ELSE ce_prob END, 6) AS ce_prob FROM pairs")
def swap_unseen(spark, d):
    p = pairs_of(spark, d)
    new = p.where("label = 1").withColumn("ce_prob", F.col("prob") / 2)
    return blends.swap_unseen(p, new, _unseen(spark, d), "ce_prob").select("s1_id", "pool_id", *R6("ce_prob"))


@query(f"WITH {PAIRS}, {DIM}, {_UNSEEN}, base AS (SELECT * FROM pairs WHERE label = 0), new AS (SELECT s1_id, pool_id, ce_prob AS prob FROM pairs WHERE ce_prob > 0.3 AND s1_id IN (SELECT s1_id FROM unseen)) SELECT s1_id, pool_id, round(prob, 6) AS prob FROM new UNION ALL SELECT s1_id, pool_id, round(prob, 6) FROM base ANTI JOIN new USING (s1_id, pool_id)")
def override_append(spark, d):
    p = pairs_of(spark, d)
    new = p.where("ce_prob > 0.3").select("s1_id", "pool_id", F.col("ce_prob").alias("prob"))
    return blends.override_append(p.where("label = 0"), new, _unseen(spark, d)).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {PAIRS}, {DIM}, {_UNSEEN} SELECT s1_id, pool_id, round(CASE WHEN s1_id IN (SELECT s1_id FROM unseen) THEN {SIG(f'0.7 * {LOGIT("prob")} + 0.3 * {LOGIT("ce_prob")}')} ELSE {CLIP('prob')} END, 6) AS prob FROM pairs")
def mix_unseen(spark, d):
    p = pairs_of(spark, d)
    return blends.mix_unseen(p, p.select("s1_id", "pool_id", F.col("ce_prob").alias("prob")), _unseen(spark, d), 0.3).select("s1_id", "pool_id", *R6("prob"))


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, round({SIG(f'({LOGIT("ce_prob")} + {LOGIT("prob")}) / 2')}, 6) AS ce_prob FROM pairs WHERE prob > 0.1")
def ce_average(spark, d):
    p = pairs_of(spark, d)
    return blends.average([p, p.where("prob > 0.1").select("s1_id", "pool_id", F.col("prob").alias("ce_prob"))]).select("s1_id", "pool_id", *R6("ce_prob"))


@query(f"WITH {PAIRS} SELECT round(corr({LOGIT('prob')}, {LOGIT('ce_prob')}), 5) AS corr FROM pairs")
def member_correlation(spark, d):
    p = pairs_of(spark, d)
    return blends.member_correlation(p, p.select("s1_id", "pool_id", F.col("prob").alias("ce_prob"))).select(F.round("corr", 5).alias("corr"))


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, round(CASE WHEN label = 1 THEN ce_prob ELSE prob END, 6) AS ce_prob FROM pairs WHERE label = 1 OR prob > 0.5")
def score_dedupe_priority(spark, d):
    p = pairs_of(spark, d)
    return blends.first_of([p.where("label = 1").select("s1_id", "pool_id", "ce_prob"), p.where("prob > 0.5").select("s1_id", "pool_id", F.col("prob").alias("ce_prob"))]).select("s1_id", "pool_id", *R6("ce_prob"))


@query(f"WITH {PAIRS}, {O2O}, {EXPF}, top AS (SELECT *, max(prob) OVER (PARTITION BY pool_id) AS b FROM pairs) SELECT s1_id, pool_id FROM pred UNION SELECT s1_id, pool_id FROM top WHERE prob >= 0.3 AND prob = b AND pool_id % 3 = 0 AND pool_id NOT IN (SELECT pool_id FROM pred)")
def assign_rule(spark, d):
    p, pred, _ = decided(spark, d)
    return blends.assign_empty_address(p.withColumn("empty_addr", F.col("pool_id") % 3 == 0), pred, 0.3)


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, count(*) OVER g AS n_cands, round({_FILL}, 6) AS blend, row_number() OVER (PARTITION BY s1_id ORDER BY ce_prob DESC, pool_id) AS ctx_ce_prob_rank, round(sum(prob) OVER g, 6) AS ctx_lgbm_sum FROM pairs WINDOW g AS (PARTITION BY s1_id)")
def stack_features(spark, d):
    p = pairs_of(spark, d).withColumnRenamed("prob", "lgbm_prob")
    return blends.stack_features(p, p).select("s1_id", "pool_id", "n_cands", *R6("blend"), "ctx_ce_prob_rank", *R6("ctx_lgbm_sum"))


# --- blocking


_RANKS = """tok AS (SELECT s1_id, pool_id, prob AS tok_score, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, pool_id) AS tok_rank FROM pairs WHERE label = 0),
emb AS (SELECT s1_id, pool_id, ce_prob AS emb_score, row_number() OVER (PARTITION BY s1_id ORDER BY ce_prob DESC, pool_id) AS emb_rank FROM pairs WHERE prob > 0.2)"""


@query(
    f"""WITH {PAIRS}, {_RANKS}, u AS (SELECT s1_id, pool_id, coalesce(tok_score, 0) AS tok_score, coalesce(tok_rank, 999) AS tok_rank, coalesce(emb_score, 0) AS emb_score, coalesce(emb_rank, 999) AS emb_rank FROM tok FULL JOIN emb USING (s1_id, pool_id)),
r AS (SELECT *, least(tok_rank, emb_rank) AS best_rank FROM u), c AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY best_rank, pool_id) AS k FROM r)
SELECT s1_id, pool_id, round(tok_score, 6) AS tok_score, tok_rank, round(emb_score, 6) AS emb_score, emb_rank, best_rank FROM c WHERE k <= 3"""
)
def cap_union(spark, d):
    from pyspark.sql import Window as W

    p = pairs_of(spark, d)
    rank = lambda s: F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc(s), "pool_id"))
    tok = p.where("label = 0").select("s1_id", "pool_id", F.col("prob").alias("tok_score"), rank("prob").alias("tok_rank"))
    emb = p.where("prob > 0.2").select("s1_id", "pool_id", F.col("ce_prob").alias("emb_score"), rank("ce_prob").alias("emb_rank"))
    return blocking.union_passes(tok, emb, 3).select("s1_id", "pool_id", *R6("tok_score"), "tok_rank", *R6("emb_score"), "emb_rank", "best_rank")


def text_sides(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("country"), F.split(F.btrim(F.lower("text"), F.lit(" \t\n\x0b\f\r")), "[ \\t\\n\\x0b\\f\\r]+").alias("tokens"), (F.substring("source", 4, 9).cast("int") % 3).alias("side"))
    return docs.where("side = 0").withColumnRenamed("doc_id", "s1_id").drop("side"), docs.where("side <> 0").withColumnRenamed("doc_id", "pool_id").drop("side")


@query(
    r"""WITH t AS (SELECT DISTINCT doc_id, lang, CAST(substr(source, 4) AS INT) % 3 AS side, unnest(string_split(trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ')) AS tok FROM documents),
n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 <> 0 GROUP BY ALL),
w AS (SELECT lang, tok, ln(1 + max(n) / count(*)) AS w FROM t JOIN n USING (lang) WHERE side <> 0 GROUP BY lang, tok HAVING count(*) <= 3000),
x AS (SELECT doc_id, lang, side, tok, w FROM t JOIN w USING (lang, tok)), m AS (SELECT doc_id, sqrt(sum(w * w)) + 1e-6 AS norm FROM x GROUP BY ALL),
s AS (SELECT a.doc_id AS s1_id, b.doc_id AS pool_id, sum(a.w * a.w) AS dot FROM x a JOIN x b ON a.lang = b.lang AND a.tok = b.tok AND a.side = 0 AND b.side <> 0 GROUP BY ALL),
c AS (SELECT s1_id, pool_id, dot / (p.norm * q.norm) AS score FROM s JOIN m p ON p.doc_id = s1_id JOIN m q ON q.doc_id = pool_id)
SELECT s1_id, pool_id, round(score, 6) AS tok_score, tok_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, pool_id) AS tok_rank FROM c) WHERE tok_rank <= 12"""
)
def token_block(spark, d):
    q, p = text_sides(spark, d)
    return blocking.token_pass(q, p).select("s1_id", "pool_id", *R6("tok_score"), "tok_rank")


def vector_sides(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("country"), "embedding")
    return v.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "s1_id"), v.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "pool_id")


KNN = """knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, pool_id) AS emb_rank FROM
  (SELECT a.vec_id AS s1_id, b.vec_id AS pool_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)) WHERE emb_rank <= 50)"""


@query(f"WITH {KNN} SELECT s1_id, pool_id, round(score, 5) AS emb_score, emb_rank FROM knn WHERE emb_rank <= 20")
def knn_block(spark, d):
    q, p = vector_sides(spark, d)
    return blocking.vector_pass(q, p, 20).select("s1_id", "pool_id", F.round("emb_score", 5).alias("emb_score"), "emb_rank")


_VGOLD = "gold AS (SELECT a.vec_id AS s1_id, b.vec_id AS pool_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 AND (a.vec_id + b.vec_id) % 7 = 0)"


def vector_gold(spark, d):
    q, p = vector_sides(spark, d)
    return q.join(p.drop("embedding"), "country").where("(s1_id + pool_id) % 7 = 0").select("s1_id", "pool_id")


@query(f"WITH {KNN}, {_VGOLD}, g AS (SELECT emb_rank FROM gold LEFT JOIN knn USING (s1_id, pool_id)) SELECT k, round(sum(CASE WHEN emb_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS recall FROM g, (SELECT unnest([5, 10, 20, 30, 50]) AS k) GROUP BY k")
def recall_at_k(spark, d):
    q, p = vector_sides(spark, d)
    return metrics.recall_at(blocking.vector_pass(q, p, 50), "emb_rank", vector_gold(spark, d)).select("k", *R6("recall"))


@query(f"WITH {PAIRS} SELECT round(sum(CASE WHEN prob >= 0.3 THEN 1 ELSE 0 END) / count(*), 6) AS recall, count(*) AS n_gold FROM pairs WHERE label = 1")
def blocking_recall(spark, d):
    p = pairs_of(spark, d)
    return metrics.blocking_recall(p.where("prob >= 0.3"), gold_of(p)).select(*R6("recall"), "n_gold")


# --- texts


def heads(spark, d):
    """The first line of each document as a name, all its other lines as an address."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", 2)
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\t\\n\\x0b\\f\\r]+", " "))
    return table(spark, d, "documents").select("doc_id", "lang", plain(F.get(lines, F.lit(0))).alias("business_name"), plain(F.get(lines, F.lit(1))).alias("business_address"))


_LINES = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_HEADS = f"""heads AS (SELECT doc_id, lang, {_LINES("regexp_extract(t, '^([^\\n]*)', 1)")} AS business_name, {_LINES("CASE WHEN contains(t, chr(10)) THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END")} AS business_address FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents))"""


@query(f"SELECT doc_id, {ts.basic(ts.ascii_form("coalesce(text, '')"))} AS basic FROM documents")
def basic_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.basic(F.col("text")).alias("basic"))


@query(f"SELECT c_custkey, {ts.skeleton('lower(c_mktsegment)')} AS skeleton FROM customer")
def skeleton(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.skeleton(F.lower("c_mktsegment")).alias("skeleton"))


@query(
    "SELECT s_suppkey, CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z].*[a-z]') THEN translate(x, '0136', 'oieg') ELSE x END AS ocr FROM (SELECT s_suppkey, replace(lower(s_name), '#', '') AS x FROM supplier)"
)
def ocr_repair(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", tx.fix_ocr(F.replace(F.lower("s_name"), F.lit("#"), F.lit(""))).alias("ocr"))


@query(f"WITH {_HEADS}, {ts.name_views('heads')} SELECT * FROM names")
def name_views(spark, d):
    return tx.name_views(heads(spark, d)).select("doc_id", "name_clean", "name_core", "name_skel", "name_ns", "name_alt", "name_alt_skel")


@query(f"WITH {_HEADS}, {ts.address_views('heads')} SELECT * FROM addresses")
def address_views(spark, d):
    return tx.address_views(heads(spark, d)).select("doc_id", "addr_clean", "postal", "nums", "landmarks")


@query(r"SELECT page_id, regexp_extract(lower(url), '(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|net|org|in|co\.in|co|fr|us|biz|info|io)\b', 1) AS stem FROM pages")
def url_stem(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract(F.lower("url"), tx.URL, 1).alias("stem"))


_TOK = lambda c: f"list_distinct(list_filter(string_split(lower({c}), ' '), lambda x: x <> ''))"


@query(
    f"""WITH {_HEADS}, s AS (SELECT doc_id, {_TOK('business_name')} AS a, {_TOK('business_address')} AS b FROM heads)
SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS jaccard, len(list_intersect(a, b)) AS shared,
CASE WHEN len(a) > 0 AND len(b) > 0 THEN 1 ELSE 0 END AS both_sides, CASE WHEN len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 THEN 1 ELSE 0 END AS conflict FROM s"""
)
def set_stats(spark, d):
    h = heads(spark, d)
    a, b = tx.token_set(F.lower("business_name")), tx.token_set(F.lower("business_address"))
    return h.select("doc_id", F.round(sm.jaccard(a, b), 6).alias("jaccard"), sm.shared(a, b).alias("shared"), sm.both_sides(a, b).alias("both_sides"), sm.conflict(a, b).alias("conflict"))


def part_pairs(spark, d):
    p = table(spark, d, "part").select("p_name").distinct()
    return p.select(F.col("p_name").alias("a")).join(p.select(F.col("p_name").alias("b")), F.left("a", F.lit(1)) <= F.left("b", F.lit(1)))


_PARTS = "pp AS (SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON left(a.p_name, 1) <= left(b.p_name, 1))"


@query(f"WITH {_PARTS} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM pp")
def jaro_winkler(spark, d):
    return part_pairs(spark, d).select("a", "b", F.round(sm.scorer("jaro_winkler")("a", "b"), 6).alias("jaro_winkler"))


@query(f"WITH {_PARTS} SELECT a, b, levenshtein(a, b) AS distance FROM pp")
def levenshtein_house(spark, d):
    return part_pairs(spark, d).select("a", "b", F.levenshtein("a", "b").alias("distance"))


@query(f"WITH RECURSIVE {_PARTS}, {ts.fuzzy('pp')} SELECT a, b, round(ratio, 6) AS ratio, round(partial, 6) AS partial, round(token_sort, 6) AS token_sort, round(token_set, 6) AS token_set FROM fuzzy")
def fuzzy_ratios(spark, d):
    names = ["ratio", "partial", "token_sort", "token_set"]
    f = sm.scores([(F.col("a"), F.col("b"), n) for n in names])
    return part_pairs(spark, d).withColumn("f", f).select("a", "b", *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(names)])


_VIEWS = f"{_HEADS}, {ts.name_views('heads')}, {ts.address_views('heads')}, views AS (SELECT * FROM names JOIN addresses USING (doc_id))"
_SIDES = ", ".join(f"{s}.{v} AS {s}_{v}" for v in ("name_skel", "name_clean", "addr_clean") for s in "ab")


@query(f"WITH {_VIEWS}, sides AS (SELECT a.doc_id, {_SIDES} FROM views a JOIN views b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1), {ts.decoys('sides')}")
def decoy_features(spark, d):
    h = tx.address_views(tx.name_views(heads(spark, d)))
    a, b = h.where("doc_id % 2 = 0"), h.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)
    v = ["name_skel", "name_clean", "addr_clean"]
    both = a.select("doc_id", *[F.col(x).alias(f"a_{x}") for x in v]).join(b.select("doc_id", *[F.col(x).alias(f"b_{x}") for x in v]), "doc_id")
    cols = features.decoy_features(*[F.col(f"{s}_{x}") for x in v for s in "ab"])
    return both.select("doc_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


def entities(spark, d):
    """Parts as records: their names, and size, brand and type as an address; a type is a country."""
    p = table(spark, d, "part").repartition(tasks_of(spark), "p_partkey")
    h = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("business_name"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand", "p_type").alias("business_address"), F.col("p_type").alias("country"), F.lit(2).alias("source"))
    h = written(tx.normalize(h), "entities")  # as the normalize stage's table
    return h.where("entity_id % 3 = 0"), h.where("entity_id % 3 <> 0")


@query()
def pair_features(spark, d):
    s1, pool = entities(spark, d)
    side = lambda df, i: df.select(F.col("entity_id").alias(i), F.col("country_norm").alias("country"), tx.token_docs(df).alias("tokens"))
    cands = blocking.block_all(side(s1, "s1_id"), side(pool, "pool_id"))
    return features.pair_features(context.global_context(cands), s1, pool)


_RECORDS = f"""recs AS (SELECT p_partkey AS doc_id, p_name AS business_name, concat_ws(' ', CAST(p_size AS VARCHAR), p_brand, p_type) AS business_address FROM part),
{ts.name_views('recs')}, {ts.address_views('recs')}, sides AS (SELECT a.doc_id AS s1_id, a.doc_id + 1 AS pool_id, a.name_core AS an, coalesce(b.name_core, '') AS bn, a.addr_clean AS aa, coalesce(b.addr_clean, '') AS ba, a.nums AS au, coalesce(b.nums, '') AS bu,
  trim(regexp_replace(regexp_replace(a.addr_clean, '[0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS as_, trim(regexp_replace(regexp_replace(coalesce(b.addr_clean, ''), '[0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS bs
  FROM (SELECT * FROM names JOIN addresses USING (doc_id)) a LEFT JOIN (SELECT * FROM names JOIN addresses USING (doc_id)) b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 3 = 0),
three AS (SELECT DISTINCT an AS a, bn AS b FROM sides UNION SELECT aa, ba FROM sides UNION SELECT as_, bs FROM sides)"""


@query(
    f"""WITH RECURSIVE {_RECORDS}, {ts.fuzzy('three')} SELECT s1_id, pool_id, round(n.token_set, 6) AS r_name_tset, CAST(an = bn AS INT) AS r_name_eq, CASE WHEN aa <> '' AND ba <> '' THEN round(d.token_set, 6) END AS r_addr_tset, CASE WHEN aa <> '' AND ba <> '' THEN round(s.token_set, 6) END AS r_street_tset,
CAST(split_part(au, ' ', 1) <> '' AND split_part(au, ' ', 1) = split_part(bu, ' ', 1) AS INT) AS r_num_eq, CAST(au <> '' AND bu <> '' AND len(list_intersect(string_split(au, ' '), string_split(bu, ' '))) = 0 AS INT) AS r_num_conflict
FROM sides JOIN fuzzy n ON n.a = an AND n.b = bn JOIN fuzzy d ON d.a = aa AND d.b = ba JOIN fuzzy s ON s.a = as_ AND s.b = bs"""
)
def raw_features(spark, d):
    s1, pool = entities(spark, d)
    pairs = s1.select(F.col("entity_id").alias("s1_id"), (F.col("entity_id") + 1).alias("pool_id"))
    return features.raw_features(pairs, s1, pool).select("s1_id", "pool_id", *R6("r_name_tset"), "r_name_eq", *R6("r_addr_tset", "r_street_tset"), "r_num_eq", "r_num_conflict")


@query(r"SELECT conv_id, turn, regexp_matches(text, '[^\x00-\x{24F}]') AS non_latin FROM conversations")
def non_latin(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.has_non_latin(F.col("text")).alias("non_latin"))


# --- lists, folds, checks


@query(f"WITH {PAIRS}, {DIM} SELECT dim.s1_id AS source1_entity_id, coalesce(string_agg(pool_id, ',' ORDER BY prob DESC, pool_id), '') AS matched_entity_ids FROM dim LEFT JOIN pairs ON pairs.s1_id = dim.s1_id AND label = 1 GROUP BY ALL")
def id_list_write(spark, d):
    p = pairs_of(spark, d)
    lists = p.where("label = 1").groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("prob").alias("p"), "pool_id"))), lambda x: x["pool_id"].cast("string")).alias("ids"))
    return sinks.list_rows(lists, dimension_of(spark, d).select("s1_id"), "matched_entity_ids")


@query(f"WITH {PAIRS} SELECT s1_id, pool_id FROM pairs WHERE label = 1")
def gold_explode(spark, d):
    lists = id_list_write(spark, d)
    each = F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != ""))
    return lists.select(F.col("source1_entity_id").alias("s1_id"), each.alias("pool_id")).select("s1_id", F.col("pool_id").cast("long").alias("pool_id"))


@query(f"WITH RECURSIVE keys AS (SELECT o_orderkey AS k FROM orders), {ts.crc32('keys')} SELECT o_orderkey, CAST(v % 5 AS INT) AS fold5, CAST(v % 10 AS INT) AS fold10, CAST(v % 20 AS INT) AS fold20 FROM orders JOIN crc ON k = o_orderkey")
def crc_folds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.select("o_orderkey", *[sc.fold(F.col("o_orderkey"), n).alias(f"fold{n}") for n in (5, 10, 20)])


@query("SELECT o_orderkey AS s1_id FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample(spark, d):
    return folds.sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("s1_id")), 500)


@query("SELECT o_orderkey AS s1_id FROM orders WHERE CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.25")
def hash_fraction(spark, d):
    return folds.fraction(table(spark, d, "orders").select(F.col("o_orderkey").alias("s1_id")), 0.25)


@query(
    f"""WITH {_HEADS}, w AS (SELECT doc_id AS s1_id, lang AS country, {ts.words('business_address')} AS w FROM heads), p AS (SELECT s1_id, country, row_number() OVER (PARTITION BY country ORDER BY array_to_string(w[greatest(len(w) - 1, 1):], ' '), s1_id) - 1 AS place FROM w),
b AS (SELECT s1_id, country, 1 AS round, place // 16 AS batch FROM p) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, batch) AS n FROM b) WHERE n = 16"""
)
def area_batches(spark, d):
    h = heads(spark, d).select(F.col("doc_id").alias("s1_id"), F.col("doc_id").alias("pool_id"), F.col("lang").alias("country"), F.col("business_address").alias("text"))
    return folds.area_batches(h, 16).select("s1_id", "country", "round", "batch", F.lit(16).alias("n"))


@query(
    f"""WITH {PAIRS}, l AS (SELECT s1_id, pool_id, CASE WHEN pool_id % 10 = 0 THEN 'S1-' WHEN pool_id % 10 = 1 THEN 'X9-' ELSE 'S2-' END || pool_id AS x FROM pairs WHERE label = 1),
f AS (SELECT DISTINCT 'self_match' AS kind, x FROM l WHERE x LIKE 'S1-%' UNION SELECT DISTINCT 'wrong_prefix', x FROM l WHERE x LIKE 'X9-%'
 UNION SELECT 'missing', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 <> 1 AND o_orderkey NOT IN (SELECT s1_id FROM l) UNION SELECT 'extra', CAST(s1_id AS VARCHAR) FROM l WHERE s1_id % 5 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY x) AS k FROM f)
SELECT kind, count(*) AS n, string_agg(x, ', ' ORDER BY x) FILTER (k <= 5) AS examples FROM r GROUP BY kind"""
)
def validator_findings(spark, d):
    p = gold_of(pairs_of(spark, d))
    prefix = F.when(F.col("pool_id") % 10 == 0, "S1-").when(F.col("pool_id") % 10 == 1, "X9-").otherwise("S2-")
    lists = p.groupBy("s1_id").agg(F.collect_list(F.concat(prefix, F.col("pool_id").cast("string"))).alias("ids"))
    required = table(spark, d, "orders").where("o_orderkey % 5 <> 1").select(F.col("o_orderkey").alias("s1_id"))
    return validate.findings(lists, required)


@query(f"WITH {CHAIN}, a AS (SELECT s1_id, pool_id FROM pred), b AS (SELECT s1_id, pool_id FROM pairs WHERE prob >= 0.5), ca AS (SELECT s1_id, count(*) AS na FROM a GROUP BY ALL), cb AS (SELECT s1_id, count(*) AS nb FROM b GROUP BY ALL), cc AS (SELECT s1_id, count(*) AS nc FROM a JOIN b USING (s1_id, pool_id) GROUP BY ALL), x AS (SELECT country, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc FROM dim LEFT JOIN ca USING (s1_id) LEFT JOIN cb USING (s1_id) LEFT JOIN cc USING (s1_id)) SELECT country, count(*) AS n_s1, round(avg(CASE WHEN na <> nc OR nb <> nc THEN 1.0 ELSE 0.0 END), 6) AS changed, sum(na) AS matches_a, sum(nb) AS matches_b, sum(nc) AS shared, round(avg(CASE WHEN na = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_a, round(avg(CASE WHEN nb = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_b FROM x GROUP BY country")
def submission_diff(spark, d):
    p, pred, dim = decided(spark, d)
    return metrics.submission_diff(pred, p.where("prob >= 0.5"), dim).select("country", "n_s1", *R6("changed"), "matches_a", "matches_b", "shared", *R6("empty_a", "empty_b"))


@query(f"WITH {PAIRS}, {DIM}, g AS (SELECT dim.s1_id, coalesce(sum(label), 0) AS n_match FROM dim LEFT JOIN pairs USING (s1_id) GROUP BY ALL) SELECT n_match, count(*) AS n_s1 FROM g GROUP BY ALL")
def eda_match_counts(spark, d):
    return reports.match_counts(gold_of(pairs_of(spark, d)), dimension_of(spark, d))


@query(f"WITH {PAIRS} SELECT count(*) AS violations FROM (SELECT pool_id FROM pairs WHERE label = 1 GROUP BY pool_id HAVING count(*) > 1)")
def o2o_violations(spark, d):
    return reports.one_to_one_violations(gold_of(pairs_of(spark, d)))


@query(rf"WITH {_HEADS} SELECT CAST(doc_id % 3 AS INT) AS source, lang AS country, count(*) AS n, round(avg(CASE WHEN business_address = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_address, round(avg(CASE WHEN regexp_matches(business_name, '[^\x00-\x{{24F}}]') THEN 1.0 ELSE 0.0 END), 6) AS non_latin FROM heads GROUP BY ALL")
def eda_profile(spark, d):
    h = heads(spark, d).withColumn("source", (F.col("doc_id") % 3).cast("int")).withColumn("country", F.col("lang"))
    return reports.profile(h).select("source", "country", "n", *R6("empty_address", "non_latin"))


@query(f"WITH {PAIRS}, r AS (SELECT label, prob, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS k FROM pairs) SELECT round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) AS auc, round(avg(-ln(CASE WHEN label = 1 THEN least(greatest(prob, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(prob, 1e-15), 1 - 1e-15) END)), 6) AS logloss FROM r")
def auc_logloss(spark, d):
    return metrics.auc(pairs_of(spark, d), "prob", "label").select(*R6("auc", "logloss"))


_FAST = " UNION ALL ".join(f"SELECT {i} AS place, 'expf' AS method, NULL::DOUBLE AS t, NULL::DOUBLE AS r, {p.alpha} AS alpha" for i, p in enumerate(decide.FAST_GRID))


def _half(h: int) -> str:
    """Tables of one half of fold 0, which is fold h of ten: its pairs and its records."""
    return f"p{h} AS (SELECT pairs.* FROM pairs JOIN crc ON k = s1_id WHERE v % 10 = {h}), d{h} AS (SELECT dim.* FROM dim JOIN crc ON k = s1_id WHERE v % 10 = {h})"


def _chosen(h: int, other: int) -> str:
    return f"""best{other} AS (WITH {_tune_sql(f'p{other}', f'd{other}', _FAST, 'true')} SELECT alpha FROM tuned ORDER BY round(macro_f05, 12) DESC, place LIMIT 1),
o{h} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY prob DESC, s1_id) AS r FROM p{h}) WHERE r = 1),
x{h} AS (SELECT s1_id, prob, label, row_number() OVER o AS k, 1.25 * sum(prob) OVER (o ROWS UNBOUNDED PRECEDING) / (0.25 * sum(prob) OVER g + row_number() OVER o) AS e, product(1 - prob) OVER g AS none FROM o{h} WINDOW o AS (PARTITION BY s1_id ORDER BY prob DESC, pool_id), g AS (PARTITION BY s1_id)),
y{h} AS (SELECT *, max(e) OVER (PARTITION BY s1_id) AS best FROM x{h}), z{h} AS (SELECT *, min(CASE WHEN e = best THEN k END) OVER (PARTITION BY s1_id) AS kk FROM y{h}),
c{h} AS (SELECT s1_id, count(*) AS np, sum(label) AS tp FROM z{h} WHERE k <= kk AND best > (SELECT alpha FROM best{other}) * none GROUP BY ALL),
s{h} AS (SELECT country, {F05} AS f FROM (SELECT country, s1_id, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(ng, 0) AS ng FROM d{h} LEFT JOIN c{h} USING (s1_id) LEFT JOIN (SELECT s1_id, sum(label) AS ng FROM p{h} GROUP BY ALL) USING (s1_id)))"""


@query(
    f"""WITH RECURSIVE {PAIRS}, {DIM}, keys AS (SELECT o_orderkey AS k FROM orders), {ts.crc32('keys')}, {_half(0)}, {_half(5)}, {_chosen(0, 5)}, {_chosen(5, 0)}
SELECT country, round(avg(f), 6) AS macro_f05, count(*) AS n FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s5) GROUP BY country"""
)
def cross_fitted(spark, d):
    p = pairs_of(spark, d)
    return reports.cross_fitted(p, gold_of(p), dimension_of(spark, d)).select("country", *R6("macro_f05"), "n")


@query()
def gbt_oof(spark, d):
    p = context.score_context(pairs_of(spark, d), "prob", "ctx")
    done, _ = learn.out_of_fold(p, ["prob", "ce_prob", "ctx_rank", "ctx_gap"], folds=2, out="oof", maxIter=3, maxDepth=3)
    return done.select("s1_id", "pool_id", F.round("oof", 6).alias("oof"))


@query()
def quarter_stack(spark, d):
    p = context.score_context(pairs_of(spark, d), "prob", "ctx")
    return learn.quarter_stack(p, ["prob", "ce_prob", "ctx_gap"], maxIter=2, maxDepth=2).select("s1_id", "pool_id", F.round("stack_prob", 6).alias("stack_prob"))


# --- more of texts, samples, sweeps and files


_LIST = lambda c: f"coalesce(array_to_string(list_sort(list_distinct({c})), ' '), '')"
_LEGAL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.LEGAL_FORMS.items()) + "}"
_MARKED = lambda c, p: f"list_transform({ts.words(c)}, lambda x: '{p}' || x)"


@query(
    rf"""WITH {_VIEWS}, x AS (SELECT views.*, business_address, {ts.words('name_core')} AS core, {ts.words('business_address')} AS aw FROM views JOIN heads USING (doc_id))
SELECT doc_id, CASE WHEN len(core) >= 2 THEN array_to_string(list_transform(core, lambda x: substr(x, 1, 1)), '') ELSE '' END AS acronym, coalesce(array_to_string({_MARKED('name_skel', 'n:')}, ' '), '') AS prefixed,
regexp_extract(addr_clean, '(?:^| )(\d+)(?: |$)', 1) AS first_number, coalesce(array_to_string(aw[greatest(len(aw) - 1, 1):], ' '), '') AS last_two, regexp_replace(addr_clean, '\d+', ' ', 'g') AS no_digits, 'query: ' || name_clean || ' | ' || addr_clean AS record_text,
{_LIST(f"list_concat({_MARKED('name_skel', 'n:')}, {_MARKED('name_alt_skel', 'n:')}, CASE WHEN len(name_ns) >= 6 THEN ['s:' || name_ns] ELSE [] END, {_MARKED('addr_clean', 'a:')})")} AS token_docs,
{_LIST(f"list_filter(list_transform({ts.words('name_clean')}, lambda x: {_LEGAL}[x]), lambda x: x IS NOT NULL)")} AS legal_forms FROM x"""
)
def text_parts(spark, d):
    h = tx.address_views(tx.name_views(heads(spark, d)))
    in_order = lambda c: F.array_join(F.array_sort(c), " ")
    c = F.col
    return h.select(
        "doc_id", tx.acronym(c("name_core")).alias("acronym"), tx.prefixed(c("name_skel"), "n:").alias("prefixed"), tx.first_number(c("addr_clean")).alias("first_number"), tx.last_two(c("business_address")).alias("last_two"),
        tx.without_digits(c("addr_clean")).alias("no_digits"), tx.record_text(c("name_clean"), c("addr_clean")).alias("record_text"), in_order(tx.token_docs(h)).alias("token_docs"), in_order(tx.legal_forms(c("name_clean"))).alias("legal_forms"),
    )


@query(
    """WITH r AS (SELECT p_partkey AS i, 'S' || (2 + p_partkey % 2) || '-' || p_partkey AS id, p_name AS n, CASE WHEN p_size > 40 THEN '' ELSE p_brand END AS a FROM part)
SELECT x.id AS s1_id, y.id AS pool_id, x.n || ' | ' || x.a AS text_a, coalesce(y.n, '') || ' | ' || coalesce(y.a, '') AS text_b, 'S' || (2 + y.i % 2) AS source_b FROM r x JOIN r y ON x.i % 3 = 0 AND y.i = x.i + 1"""
)
def pair_texts(spark, d):
    r, pairs = _keyed_parts(spark, d)
    return tx.pair_texts(pairs, r, r).select("s1_id", "pool_id", "text_a", "text_b", tx.source_of(F.col("pool_id")).alias("source_b"))


def _keyed_parts(spark, d):
    """Parts under ids with a source, those of a size over 40 without an address; each third one paired with the next."""
    c = F.col("p_partkey")
    name = lambda k: F.concat(F.lit("S"), (2 + k % 2).cast("string"), F.lit("-"), k.cast("string"))
    p = table(spark, d, "part")
    r = p.select(name(c).alias("entity_id"), F.col("p_name").alias("business_name"), F.when(F.col("p_size") > 40, "").otherwise(F.col("p_brand")).alias("business_address"))
    last = p.agg(F.max("p_partkey").alias("last"))
    pairs = p.where(c % 3 == 0).join(last, c < F.col("last")).select(name(c).alias("s1_id"), name(c + 1).alias("pool_id"))
    return r, pairs


@query(
    """WITH r AS (SELECT p_partkey AS i, 'S' || (2 + p_partkey % 2) || '-' || p_partkey AS id, len(p_name) AS n, len(CASE WHEN p_size > 40 THEN '' ELSE p_brand END) AS a FROM part)
SELECT x.id AS s1_id, y.id AS pool_id, CAST(x.n AS DOUBLE) AS len_name_a, CAST(x.a AS DOUBLE) AS len_addr_a, CAST(y.n AS DOUBLE) AS len_name_b, CAST(y.a AS DOUBLE) AS len_addr_b, CAST(y.a = 0 AS DOUBLE) AS b_empty_addr, CAST(y.i % 2 AS DOUBLE) AS b_source FROM r x JOIN r y ON x.i % 3 = 0 AND y.i = x.i + 1"""
)
def record_features(spark, d):
    r, pairs = _keyed_parts(spark, d)
    r = r.withColumnsRenamed({"business_name": "name_clean", "business_address": "addr_clean"})
    return blends.record_features(pairs, r, r).select("s1_id", "pool_id", "len_name_a", "len_addr_a", "len_name_b", "len_addr_b", "b_empty_addr", "b_source")


_ORDER_CRC = f"keys AS (SELECT o_orderkey AS k FROM orders), {ts.crc32('keys')}"


@query(f"WITH RECURSIVE {PAIRS}, {_ORDER_CRC}, g AS (SELECT s1_id, pool_id, row_number() OVER (PARTITION BY s1_id ORDER BY md5('42:' || s1_id || '|' || pool_id), pool_id) AS round FROM pairs JOIN crc ON k = s1_id WHERE label = 1 AND v % 5 <> 0) SELECT * FROM g WHERE round <= 3")
def training_pairs(spark, d):
    return folds.training_pairs(gold_of(pairs_of(spark, d))).select("s1_id", "pool_id", "round")


@query(f"WITH {PAIRS} SELECT s1_id, pool_id, label FROM pairs WHERE label = 1 OR prob >= 0.3 OR CAST('0x' || substr(md5('42:' || s1_id || '|' || pool_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.1")
def hard_pairs(spark, d):
    return folds.hard_pairs(pairs_of(spark, d), floor=0.3).select("s1_id", "pool_id", "label")


@query(f"WITH RECURSIVE {_ORDER_CRC} SELECT o_orderkey AS s1_id, CAST(v % 10 AS INT) AS half FROM orders JOIN crc ON k = o_orderkey WHERE v % 10 IN (0, 5)")
def fold_halves(spark, d):
    a, b = folds.halves(table(spark, d, "orders").select(F.col("o_orderkey").alias("s1_id")))
    return a.withColumn("half", F.lit(0)).union(b.withColumn("half", F.lit(5)))


@query(f"WITH {DIM} SELECT s1_id, country = 'NATION_3' AS held_out FROM dim")
def country_split(spark, d):
    train, test = folds.leave_out(dimension_of(spark, d), "NATION_3")
    return train.select("s1_id", F.lit(False).alias("held_out")).union(test.select("s1_id", F.lit(True)))


@query(f"WITH {PAIRS} SELECT s1_id, pool_id FROM pairs WHERE label = 1 AND s1_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND pool_id IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def resolved_pairs(spark, d):
    s1 = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entity_id"))
    pool = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("entity_id"))
    return tables.resolved(gold_of(pairs_of(spark, d)), s1, pool)


@query(f"WITH {PAIRS} SELECT s1_id, pool_id FROM pairs WHERE {_FILL} BETWEEN 0.4 AND 0.6")
def contested_pairs(spark, d):
    return pairs_of(spark, d).where(blends.contested("prob", "ce_prob", 0.4, 0.6)).select("s1_id", "pool_id")


@query(f"WITH {PAIRS}, {DIM} SELECT round(avg(CAST(country = 'NATION_' || pool_id % 25 AS INT)), 6) AS same_country, count(*) AS n FROM pairs JOIN dim USING (s1_id) WHERE label = 1")
def same_country(spark, d):
    pool = table(spark, d, "part").select(F.col("p_partkey").alias("pool_id"), F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")).alias("country"))
    return reports.same_country(gold_of(pairs_of(spark, d)), dimension_of(spark, d), pool).select(*R6("same_country"), "n")


@query("SELECT p_type, count(*) AS n_rows, count(DISTINCT p_name) AS n_p_name, count(DISTINCT p_brand) AS n_p_brand FROM part GROUP BY p_type")
def distinct_counts(spark, d):
    return reports.distinct_counts(table(spark, d, "part"), ["p_name", "p_brand"], "p_type")


@query(f"WITH {KINDS} SELECT s1_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || s1_id), s1_id) AS r FROM kinds WHERE kind IN ('all_wrong', 'extra_fp')) WHERE r <= 8")
def error_examples(spark, d):
    kinds = kinds_of(spark, d)
    return reports.error_examples(kinds, "all_wrong").union(reports.error_examples(kinds, "extra_fp")).select("s1_id", "kind")


_MACRO = lambda said, key: f"""golds AS (SELECT dim.s1_id, coalesce(sum(label), 0) AS ng FROM dim LEFT JOIN pairs USING (s1_id) GROUP BY ALL),
hits AS (SELECT {key}, s1_id, count(*) AS np, sum(label) AS tp FROM {said} GROUP BY ALL), every AS (SELECT {key}, s1_id, ng FROM (SELECT DISTINCT {key} FROM all_keys) CROSS JOIN golds)
SELECT {key}, round(avg({F05}), 6) AS macro_f05 FROM (SELECT every.{key}, ng, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM every LEFT JOIN hits ON hits.s1_id = every.s1_id AND hits.{key} = every.{key}) GROUP BY {key}"""  # noqa: E731


@query(
    f"""WITH RECURSIVE {PAIRS}, {DIM}, {O2O}, {EXPF}, {_EXACT}, all_keys AS (SELECT unnest(['expf', 'exact']) AS rule),
said AS (SELECT 'expf' AS rule, s1_id, label FROM pred UNION ALL SELECT 'exact', s1_id, label FROM ranked JOIN chosen USING (s1_id) JOIN pairs USING (s1_id, pool_id) WHERE k <= n), {_MACRO('said', 'rule')}"""
)
def rules_compared(spark, d):
    p = pairs_of(spark, d)
    return reports.rules_compared(p, gold_of(p), dimension_of(spark, d)).select("rule", *R6("macro_f05"))


@query(
    f"""WITH {PAIRS}, {DIM}, {O2O}, {EXPF}, all_keys AS (SELECT unnest([1.01, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05])::DOUBLE AS t), top AS (SELECT *, max(prob) OVER (PARTITION BY pool_id) AS b FROM pairs),
said AS (SELECT t, s1_id, pool_id, label FROM pred, all_keys UNION SELECT t, s1_id, pool_id, label FROM top, all_keys WHERE prob >= t AND prob = b AND pool_id % 3 = 0 AND pool_id NOT IN (SELECT pool_id FROM pred)), {_MACRO('said', 't')}"""
)
def assignment_sweep(spark, d):
    p, pred, dim = decided(spark, d)
    marked = p.withColumn("empty_addr", F.col("pool_id") % 3 == 0)
    return reports.assignment_sweep(marked, pred, gold_of(p), dim).select("t", *R6("macro_f05"))


@query(
    f"""WITH {PAIRS}, {DIM}, all_keys AS (SELECT unnest([-2.0, -1.5, -1.0, -0.5, 0.0, 0.5])::DOUBLE AS shift),
moved AS (SELECT shift, s1_id, pool_id, label, CASE WHEN country = 'NATION_3' THEN {SIG(LOGIT('prob') + ' + shift')} ELSE prob END AS prob FROM pairs LEFT JOIN dim USING (s1_id) CROSS JOIN all_keys),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shift, pool_id ORDER BY prob DESC, s1_id) AS r FROM moved) WHERE r = 1),
px AS (SELECT shift, s1_id, label, row_number() OVER o AS k, 1.25 * sum(prob) OVER (o ROWS UNBOUNDED PRECEDING) / (0.25 * sum(prob) OVER g + row_number() OVER o) AS e, product(1 - prob) OVER g AS none FROM best WINDOW o AS (PARTITION BY shift, s1_id ORDER BY prob DESC, pool_id), g AS (PARTITION BY shift, s1_id)),
bx AS (SELECT *, max(e) OVER (PARTITION BY shift, s1_id) AS top FROM px), kx AS (SELECT *, min(CASE WHEN e = top THEN k END) OVER (PARTITION BY shift, s1_id) AS kk FROM bx),
said AS (SELECT shift, s1_id, label FROM kx WHERE top > 1.5 * none AND k <= kk), {_MACRO('said', 'shift')}"""
)
def shift_sweep(spark, d):
    p = pairs_of(spark, d)
    return reports.shift_sweep(p, gold_of(p), dimension_of(spark, d), "NATION_3").select("shift", *R6("macro_f05"))


@query(
    r"""WITH t AS (SELECT DISTINCT doc_id, lang, CAST(substr(source, 4) AS INT) % 3 AS side, unnest(string_split(trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')), ' ')) AS tok FROM documents),
q AS (SELECT doc_id, CASE WHEN lang = 'de' THEN '*' ELSE lang END AS lang, tok FROM t WHERE side = 0), p AS (SELECT doc_id, lang, tok FROM t WHERE side <> 0 AND lang <> 'de' UNION ALL SELECT doc_id, '*', tok FROM t WHERE side <> 0 AND lang <> 'de'),
n AS (SELECT lang, count(DISTINCT doc_id) AS n FROM p GROUP BY ALL), w AS (SELECT lang, tok, ln(1 + max(n) / count(*)) AS w FROM p JOIN n USING (lang) GROUP BY lang, tok HAVING count(*) <= 3000),
x AS (SELECT * FROM q JOIN w USING (lang, tok)), y AS (SELECT * FROM p JOIN w USING (lang, tok)), nx AS (SELECT doc_id, sqrt(sum(w * w)) + 1e-6 AS norm FROM x GROUP BY ALL), ny AS (SELECT lang, doc_id, sqrt(sum(w * w)) + 1e-6 AS norm FROM y GROUP BY ALL),
s AS (SELECT x.doc_id AS s1_id, y.doc_id AS pool_id, x.lang, sum(x.w * x.w) AS dot FROM x JOIN y USING (lang, tok) GROUP BY ALL), c AS (SELECT s1_id, pool_id, dot / (nx.norm * ny.norm) AS score FROM s JOIN nx ON nx.doc_id = s1_id JOIN ny ON ny.doc_id = pool_id AND ny.lang = s.lang)
SELECT s1_id, pool_id, round(score, 6) AS tok_score, tok_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, pool_id) AS tok_rank FROM c) WHERE tok_rank <= 12"""
)
def whole_pool_block(spark, d):
    q, p = text_sides(spark, d)
    return blocking.token_pass(q, p.where("country <> 'de'")).select("s1_id", "pool_id", *R6("tok_score"), "tok_rank")


@query(f"WITH {PAIRS}, {O2O}, {EXPF} SELECT pred.s1_id, pred.pool_id FROM pred JOIN pairs USING (s1_id, pool_id) WHERE pairs.prob >= 0.2 OR pairs.ce_prob > 0.8")
def answer_files(spark, d):
    """An answer written as files and read back: matches stay within candidates and further candidates."""
    p, pred, dim = decided(spark, d)
    at = shared_dir(spark, "answer")
    sinks.write_answer(pred, p.where("prob >= 0.2"), dim.withColumn("seq", F.col("s1_id")), at, extra=p.where("ce_prob > 0.8"))
    pairs, _ = tables.load_gold(spark, f"{at}/matching_results.tsv")
    return pairs.select(F.col("s1_id").cast("long").alias("s1_id"), F.col("pool_id").cast("long").alias("pool_id"))
