"""Features of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as tx
from ..functions.scores import house_difference
from ..sources.shared import tasks_of
from .context import rank_and_gap

VIEWS = ["name_clean", "name_core", "name_skel", "name_ns", "name_alt", "addr_clean", "postal", "nums", "landmarks"]
DECOYS = ["n_extra_b", "n_extra_a", "n_extra_b_len", "a_extra_b", "a_extra_a", "a_extra_b_frac", "legal_conflict", "legal_both", "house_prefix", "house_absdiff", "house_lev", "house_samelen"]
NAME = ["n_ratio", "n_partial", "n_tsort", "n_tset", "n_jw", "n_clean_ratio", "n_skel_ratio", "n_skel_tset", "n_skel_jac", "n_skel_inter", "n_ns_ratio", "n_ns_partial", "n_exact", "n_ns_eq", "n_alt_tset", "b_has_alt"]
ADDRESS = ["a_ratio", "a_partial", "a_tset", "a_tsort", "a_jac", "a_inter", "b_addr_empty", "num_jac", "num_inter", "num_both", "num_conflict", "house_eq", "pc_jac", "pc_both", "lm_jac", "lm_inter"]
META = ["source", "len_name_a", "len_name_b", "len_addr_a", "len_addr_b"]
CONTEXT = ["name_addr", "n_tset", "a_tset", "n_skel_ratio", "emb_score", "tok_score"]
#: Groups that ablations leave out by name.
GROUPS = {"decoy": DECOYS, "emb": ["emb_score", "emb_rank", "s1_rank_emb_score", "s1_gap_emb_score", "cand_rank_emb_score", "cand_gap_emb_score", "best_rank"], "country": ["lm_jac", "lm_inter", "legal_conflict", "legal_both", "n_alt_tset", "b_has_alt"], "meta": META}


def decoy_features(a_skel: Column, b_skel: Column, a_clean: Column, b_clean: Column, a_addr: Column, b_addr: Column) -> dict[str, Column]:
    """What tells a look-alike from a match: words only one side has, legal forms and house numbers that differ."""
    none = F.lit(-1)
    sa, sb = tx.token_set(a_skel), tx.token_set(b_skel)
    extra = F.array_except(sb, sa)
    ta, tb = tx.alpha_skeletons(a_addr), tx.alpha_skeletons(b_addr)
    streets = (F.size(ta) > 0) & (F.size(tb) > 0)
    la, lb = tx.legal_forms(a_clean), tx.legal_forms(b_clean)
    legal = (F.size(la) > 0) & (F.size(lb) > 0)
    ha, hb = tx.first_number(a_addr), tx.first_number(b_addr)
    house = (ha != "") & (hb != "")
    return {
        "n_extra_b": F.size(extra),
        "n_extra_a": F.size(F.array_except(sa, sb)),
        "n_extra_b_len": F.coalesce(F.array_max(F.transform(extra, F.length)), F.lit(0)),
        "a_extra_b": F.when(streets, F.size(F.array_except(tb, ta))).otherwise(none),
        "a_extra_a": F.when(streets, F.size(F.array_except(ta, tb))).otherwise(none),
        "a_extra_b_frac": F.when(streets, F.size(F.array_except(tb, ta)) / F.size(tb)).otherwise(F.lit(-1.0)),
        "legal_conflict": F.when(legal, (~F.arrays_overlap(la, lb)).cast("int")).otherwise(none),
        "legal_both": legal.cast("int"),
        "house_prefix": F.when(house, ((ha != hb) & (F.startswith(ha, hb) | F.startswith(hb, ha))).cast("int")).otherwise(none),
        "house_absdiff": F.when(house, house_difference(F.when(house, ha), F.when(house, hb))).otherwise(F.lit(-1.0)),
        "house_lev": F.when(house, F.levenshtein(ha, hb)).otherwise(none),
        "house_samelen": F.when(house, (F.length(ha) == F.length(hb)).cast("int")).otherwise(none),
    }


def attach_records(pairs: DataFrame, s1: DataFrame, pool: DataFrame, views=VIEWS) -> DataFrame:
    """Both records' views beside each pair, as a_ and b_ columns, and the pool record's source."""
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(v).alias(f"a_{v}") for v in views])
    b = pool.select(F.col("entity_id").alias("pool_id"), "source", *[F.col(v).alias(f"b_{v}") for v in views])
    return pairs.join(a, "s1_id").join(b, "pool_id")


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """All features of candidate pairs that carry their blocking scores, and the primary record's context.

    The fuzzy scores of a row are computed in one pass over Arrow batches; the rest stays in the JVM. Pairs are dealt to
    all cores, few bytes as they are: the work on a pair is long.
    """
    df = attach_records(pairs, s1, pool).repartition(tasks_of(pairs.sparkSession), "s1_id")
    c = F.col
    fuzzy = {
        "n_ratio": ("name_core", "ratio"), "n_partial": ("name_core", "partial"), "n_tsort": ("name_core", "token_sort"), "n_tset": ("name_core", "token_set"), "n_jw": ("name_core", "jaro_winkler"),
        "n_clean_ratio": ("name_clean", "ratio"), "n_skel_ratio": ("name_skel", "ratio"), "n_skel_tset": ("name_skel", "token_set"), "n_ns_ratio": ("name_ns", "ratio"), "n_ns_partial": ("name_ns", "partial"),
        "a_ratio": ("addr_clean", "ratio"), "a_partial": ("addr_clean", "partial"), "a_tset": ("addr_clean", "token_set"), "a_tsort": ("addr_clean", "token_sort"),
    }
    asked = [(c(f"a_{v}"), c(f"b_{v}"), s) for v, s in fuzzy.values()] + [(c("a_name_core"), c("b_name_alt"), "token_set")]
    df = df.withColumn("_f", sm.scores(asked))
    sets = lambda v: (tx.token_set(c(f"a_{v}")), tx.token_set(c(f"b_{v}")))
    skel, addr, nums, postal, marks = (sets(v) for v in ("name_skel", "addr_clean", "nums", "postal", "landmarks"))
    ha, hb = tx.first_number(c("a_addr_clean")), tx.first_number(c("b_addr_clean"))
    has_alt = c("b_name_alt") != ""
    cols = {n: c("_f")[i] for i, n in enumerate(fuzzy)}
    cols |= {
        "n_skel_jac": sm.jaccard(*skel), "n_skel_inter": sm.shared(*skel), "n_exact": (c("a_name_core") == c("b_name_core")).cast("int"), "n_ns_eq": (c("a_name_ns") == c("b_name_ns")).cast("int"),
        "n_alt_tset": F.when(has_alt, c("_f")[len(fuzzy)]).otherwise(F.lit(-1.0)), "b_has_alt": has_alt.cast("int"),
        "a_jac": sm.jaccard(*addr), "a_inter": sm.shared(*addr), "b_addr_empty": (c("b_addr_clean") == "").cast("int"),
        "num_jac": sm.jaccard(*nums), "num_inter": sm.shared(*nums), "num_both": sm.both_sides(*nums), "num_conflict": sm.conflict(*nums),
        "house_eq": F.when((ha != "") & (hb != ""), (ha == hb).cast("int")).otherwise(F.lit(-1)),
        "pc_jac": sm.jaccard(*postal), "pc_both": sm.both_sides(*postal), "lm_jac": sm.jaccard(*marks), "lm_inter": sm.shared(*marks),
        "len_name_a": F.length("a_name_core"), "len_name_b": F.length("b_name_core"), "len_addr_a": F.length("a_addr_clean"), "len_addr_b": F.length("b_addr_clean"),
    }
    cols |= decoy_features(c("a_name_skel"), c("b_name_skel"), c("a_name_clean"), c("b_name_clean"), c("a_addr_clean"), c("b_addr_clean"))
    out = df.select(*pairs.columns, "source", *[v.alias(n) for n, v in cols.items()])
    out = out.withColumn("name_addr", 0.6 * c("n_tset") + 0.4 * c("a_tset"))
    for s in CONTEXT:
        if s in out.columns:
            out = rank_and_gap(out, "s1_id", s, "s1")
    return out


def raw_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Six pieces of raw evidence; address similarities are null where an address is missing. Unknown ids read as empty."""
    views = ["name_core", "addr_clean", "nums"]
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(v).alias(f"a_{v}") for v in views])
    b = pool.select(F.col("entity_id").alias("pool_id"), *[F.col(v).alias(f"b_{v}") for v in views])
    df = pairs.select("s1_id", "pool_id").join(a, "s1_id", "left").join(b, "pool_id", "left").fillna("", [f"{s}_{v}" for s in "ab" for v in views])
    c = F.col
    plain = lambda s: F.trim(F.regexp_replace(tx.without_digits(c(f"{s}_addr_clean")), " +", " "))
    f = sm.scores([(c("a_name_core"), c("b_name_core"), "token_set"), (c("a_addr_clean"), c("b_addr_clean"), "token_set"), (plain("a"), plain("b"), "token_set")])
    na, nb = tx.token_set(c("a_nums")), tx.token_set(c("b_nums"))
    both = (c("a_addr_clean") != "") & (c("b_addr_clean") != "")
    first = lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(""))
    return df.withColumn("_f", f).select(
        "s1_id", "pool_id", c("_f")[0].alias("r_name_tset"), (c("a_name_core") == c("b_name_core")).cast("int").alias("r_name_eq"), F.when(both, c("_f")[1]).alias("r_addr_tset"), F.when(both, c("_f")[2]).alias("r_street_tset"),
        ((first(na) != "") & (first(na) == first(nb))).cast("int").alias("r_num_eq"), sm.conflict(na, nb).alias("r_num_conflict"),
    )
