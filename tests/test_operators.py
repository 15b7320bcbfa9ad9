import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import scores as sc
from matchloom.operators import blends, blocking, context, decide, features, folds, metrics, validate
from matchloom.sources import sinks, tables


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, pool_id string, prob double")


def kept(df):
    return {(r["s1_id"], r["pool_id"]) for r in df.collect()}


def test_folds(spark):
    df = spark.createDataFrame([("S1-000001",), ("S1-000010",), ("S1-000123",)], "id string")
    got = [tuple(r) for r in df.select(*[sc.fold(F.col("id"), n) for n in (5, 10, 20)]).collect()]
    assert got == [(3, 3, 13), (0, 0, 10), (2, 2, 12)]


def test_decisions(spark):
    p = pairs(spark, [("s1", "p1", 0.9), ("s2", "p1", 0.8), ("s2", "p2", 0.4)])
    assert kept(decide.one_to_one(p)) == {("s1", "p1"), ("s2", "p2")}
    p = pairs(spark, [("s", "a", 0.9), ("s", "b", 0.6), ("s", "c", 0.5)])
    assert kept(decide.choose_thresh(p, 0.5, 0.6)) == {("s", "a"), ("s", "b")}
    assert not kept(decide.choose_thresh(p, 0.95, 0.0))
    p = pairs(spark, [("s", "a", 0.9), ("s", "b", 0.6), ("s", "c", 0.1)])
    e = {r["k"]: (r["e_k"], r["none"]) for r in decide.expected_prefixes(p).collect()}
    assert e[1] == pytest.approx((0.803571, 0.036), abs=1e-6) and e[2][0] == pytest.approx(0.78125) and e[3][0] == pytest.approx(0.588235, abs=1e-6)
    assert kept(decide.choose_expf(p, 1.5)) == {("s", "a")}
    assert not kept(decide.choose_expf(pairs(spark, [("s", "a", 0.02)]), 1.5))
    assert kept(decide.choose_exact(pairs(spark, [("s", "a", 0.9), ("s", "b", 0.6)]), 1.5)) == {("s", "a")}
    assert decide.exact_choice([1.0, 1.0, 0.0], 1.5) == 2


def test_tune_agrees_with_deciding(spark):
    p = pairs(spark, [("s1", "a", 0.9), ("s1", "b", 0.6), ("s2", "a", 0.95), ("s3", "c", 0.3), ("s4", "d", 0.5)])
    gold = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s3", "c")], "s1_id string, pool_id string")
    dim = spark.createDataFrame([(f"s{i}", "x") for i in range(1, 6)], "s1_id string, country string")
    grid = [decide.Params("thresh", 0.5, 0.0), decide.Params("thresh", 0.2, 0.6), decide.Params("expf", alpha=0.5), decide.Params("expf", alpha=2.0)]
    tuned = {(r["place"]): r for r in decide.tune(p, gold, dim, grid).collect()}
    for i, (o, g) in enumerate((o, g) for o in (True, False) for g in grid):
        pred = decide.decide(p, decide.Params(g.method, g.t, g.r, g.alpha, o))
        want = metrics.f05_by_entity(pred, gold, dim).agg(F.avg("f05")).first()[0]
        assert tuned[i]["macro_f05"] == pytest.approx(want)


def test_metrics_and_loss(spark):
    dim = spark.createDataFrame([(s, "x") for s in "abcdefgh"], "s1_id string, country string")
    gold = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("d", "5"), ("e", "6"), ("e", "7"), ("f", "8"), ("f", "9")], "s1_id string, pool_id string")
    pred = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "x"), ("d", "y"), ("e", "6"), ("f", "8"), ("f", "z"), ("g", "w")], "s1_id string, pool_id string")
    cands = spark.createDataFrame([("c", "4"), ("e", "6"), ("f", "8"), ("f", "9")], "s1_id string, pool_id string")
    kinds = metrics.loss_kinds(pred, gold, dim, cands)
    got = {r["s1_id"]: r["kind"] for r in kinds.collect()}
    assert got == {"a": "extra_fp", "b": "empty_pred_blocking", "c": "empty_pred", "d": "all_wrong", "e": "missed_blocking", "f": "fp_and_fn", "g": "singleton_fp", "h": "ok"}
    f = {r["s1_id"]: r["f05"] for r in metrics.f05_by_entity(pred, gold, dim).collect()}
    assert f["a"] == pytest.approx(2.5 / 3.5) and f["e"] == pytest.approx(1.25 / 1.5) and f["g"] == 0 and f["h"] == 1
    lost = metrics.loss_decomposition(kinds).agg(F.sum("points_lost")).first()[0]
    assert lost == pytest.approx(1 - sum(f.values()) / 8)


def test_context(spark):
    p = pairs(spark, [("g", "a", 0.9), ("g", "b", 0.9), ("g", "c", 0.4)])
    got = {r["pool_id"]: (r["s1_rank_prob"], round(r["s1_gap_prob"], 6)) for r in context.rank_and_gap(p, "s1_id", "prob", "s1").collect()}
    assert got == {"a": (1, 0.0), "b": (1, 0.0), "c": (3, 0.5)}
    got = {r["pool_id"]: (r["x_rank"], r["x_max"], round(r["x_sum"], 6), r["x_n50"], r["x_second"]) for r in context.score_context(p, "prob", "x").collect()}
    assert got == {"a": (1, 0.9, 2.2, 2, 0.9), "b": (2, 0.9, 2.2, 2, 0.9), "c": (3, 0.9, 2.2, 2, 0.9)}
    p = pairs(spark, [("A", "X", 0.9), ("B", "X", 0.9), ("C", "X", 0.2), ("A", "Y", 0.6), ("D", "Z", 0.0009)])
    got = {(r["s1_id"], r["pool_id"]): (r["pool_n"], r["pool_best_other"], r["pool_is_top"]) for r in context.pool_context(p, p).collect()}
    assert got == {("A", "X"): (3, 0.9, 1), ("B", "X"): (3, 0.9, 1), ("C", "X"): (3, 0.9, 0), ("A", "Y"): (1, 0.0, 1), ("D", "Z"): (1, None, 0)}


def test_token_pass(spark):
    q = spark.createDataFrame([("s", "k", ["n:acm", "a:elm", "a:qqq"]), ("t", "unseen", ["n:zen"])], "s1_id string, country string, tokens array<string>")
    pool = spark.createDataFrame([("p1", "k", ["n:acm", "a:elm"]), ("p2", "k", ["n:acm", "a:oak"]), ("p3", "k", ["n:zen", "a:elm"]), ("p4", "k", ["n:bolt", "a:pine"])], "pool_id string, country string, tokens array<string>")
    got = {(r["s1_id"], r["pool_id"]): (round(r["tok_score"], 6), r["tok_rank"]) for r in blocking.token_pass(q, pool).collect()}
    assert got[("s", "p1")] == (0.999999, 1) and got[("s", "p2")] == (0.398653, 2) and got[("s", "p3")] == (0.398653, 3) and ("s", "p4") not in got
    assert ("t", "p3") in got
    assert not blocking.token_pass(q.where("s1_id = 's'"), pool, max_df=1).collect()


def test_union_and_cap(spark):
    tok = spark.createDataFrame([("s", "p1", 0.9, 1), ("s", "p2", 0.5, 2)], "s1_id string, pool_id string, tok_score double, tok_rank int")
    emb = spark.createDataFrame([("s", "p2", 0.8, 1), ("s", "p3", 0.7, 2)], "s1_id string, pool_id string, emb_score double, emb_rank int")
    got = {r["pool_id"]: (r["tok_rank"], r["emb_rank"], r["best_rank"]) for r in blocking.union_passes(tok, emb, None).collect()}
    assert got == {"p1": (1, 999, 1), "p2": (2, 1, 1), "p3": (999, 2, 2)}
    assert kept(blocking.union_passes(tok, emb, 2)) == {("s", "p1"), ("s", "p2")}


def test_vector_pass_in_tiles(spark):
    import numpy as np

    x = np.random.default_rng(5).standard_normal((60, 4))
    q = spark.createDataFrame([(f"q{i}", "k", v.tolist()) for i, v in enumerate(x[:20])], "s1_id string, country string, embedding array<double>")
    p = spark.createDataFrame([(f"p{i:02}", "k", v.tolist()) for i, v in enumerate(x[20:])], "pool_id string, country string, embedding array<double>")
    got = {(r["s1_id"], r["emb_rank"]): r["pool_id"] for r in blocking.vector_pass(q, p, 3, side=7).collect()}
    for i in range(20):
        best = np.argsort(-(x[i] @ x[20:].T))[:3]
        assert [got[(f"q{i}", k + 1)] for k in range(3)] == [f"p{j:02}" for j in best]


def test_recall_at_k_searches_to_the_largest_k(spark, tmp_path):
    import numpy as np

    from matchloom.plans import catalogue

    x = np.random.default_rng(6).standard_normal((100, 4))
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pool = [i for i in range(100) if i % 5]
    ranks = [1 + sorted(pool, key=lambda j: (-round(x[i] @ x[j], 9), j)).index(j) for i in range(0, 100, 5) for j in pool if (i + j) % 7 == 0]
    got = {r["k"]: r["recall"] for r in catalogue.recall_at_k(spark, str(tmp_path)).collect()}
    assert got == {k: round(sum(r <= k for r in ranks) / len(ranks), 6) for k in (5, 10, 20, 30, 50)} and got[20] < got[30] < got[50]


def test_token_block_keeps_common_tokens(spark, tmp_path):
    from collections import Counter

    from matchloom.plans import catalogue

    # "common" is in more than 50 pool records, and a query has no other token in the pool.
    docs = [(i, "common own%d" % i, "en", "src%d" % (i % 3)) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.token_block(spark, str(tmp_path)).collect()
    assert Counter(r["s1_id"] for r in got) == {i: 12 for i in range(0, 120, 3)}
    assert sorted(r["pool_id"] for r in got if r["s1_id"] == 0) == [i for i in range(1, 18) if i % 3]  # equal scores: by id


def test_decoys(spark):
    df = spark.createDataFrame([("a b", "b ccc", "x pvt ltd", "x ltd", "18730 little ln", "1873 little st", 0), ("a", "a", "x sarl", "x sas", "", "5 oak", 1)], "as string, bs string, ac string, bc string, aa string, ba string, i int")
    cols = features.decoy_features(*[F.col(c) for c in ("as", "bs", "ac", "bc", "aa", "ba")])
    a, b = [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()]
    assert (a["n_extra_b"], a["n_extra_a"], a["n_extra_b_len"], a["legal_both"], a["legal_conflict"]) == (1, 1, 3, 1, 0)
    assert (a["house_prefix"], a["house_lev"], a["house_samelen"]) == (1, 1, 0) and a["house_absdiff"] == pytest.approx(9.732581, abs=1e-5)
    assert (b["legal_conflict"], b["house_lev"], b["a_extra_b"], b["n_extra_b_len"]) == (1, -1, -1, 0)


def test_blends(spark):
    a = spark.createDataFrame([("s", "p", 0.9, None), ("s", "q", 0.2, 0.4)], "s1_id string, pool_id string, ce_prob double, xl_prob double").withColumn("lgbm_prob", F.col("ce_prob"))
    got = {r["pool_id"]: r["xl_prob"] for r in blends.fill(a, ["xl=ce"]).collect()}
    assert got == {"p": 0.9, "q": 0.4}
    with pytest.raises(ValueError):
        blends.blend(pairs(spark, [("s", "p", 0.5), ("s", "q", 0.5)]), a.where("pool_id = 'p'"))
    z = (math.log(9) + math.log(1 / 4)) / 2
    mean = blends.average([a.where("pool_id = 'p'"), a.where("pool_id = 'p'").withColumn("ce_prob", F.lit(0.2))]).first()["ce_prob"]
    assert mean == pytest.approx(1 / (1 + math.exp(-z)))


def test_batches_hold_each_record_once(spark):
    p = spark.createDataFrame([(f"s{i % 7}", f"p{i}", "x", f"street {i} city{i % 3} st") for i in range(40)], "s1_id string, pool_id string, country string, text string")
    got = folds.area_batches(p, 5)
    assert got.groupBy("country", "round", "batch").agg(F.count("*").alias("n"), F.countDistinct("s1_id").alias("d")).where("n <> 5 OR d <> 5").count() == 0


def test_answer_round_trip(spark, tmp_path):
    dim = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "s1_id string, seq int")
    cands = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S3-2", 2), ("S1-2", "S2-9", 1)], "s1_id string, pool_id string, best_rank int")
    matches = pairs(spark, [("S1-1", "S3-2", 0.9), ("S1-1", "S2-1", 0.8), ("S1-3", "S2-7", 0.9)])
    told = sinks.write_answer(matches, cands, dim, f"file://{tmp_path}")
    assert told["records"] == 3 and told["matches_per_record"] == pytest.approx(2 / 3)
    lines = [x for f in sorted((tmp_path / "matching_results.tsv").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-2\t", "S1-1\tS3-2,S2-1", "S1-3\t"]
    assert validate.validate(spark, f"{tmp_path}/matching_results.tsv", dim, f"{tmp_path}/candidate_pairs.tsv") == ([], [])
    pool = spark.createDataFrame([("S2-1",)], "pool_id string")
    errors, _ = validate.validate(spark, f"{tmp_path}/matching_results.tsv", dim, None, pool)
    assert errors == ["matching: unknown_id (1): S3-2"]


@pytest.mark.parametrize("text, fault", [("source1_entity_id,matched_entity_ids\n", "comma_separated"), ("a\tb\n", "wrong_header"), ("", "empty"), ("SOURCE1_ENTITY_ID\tMATCHED_ENTITY_IDS\nS1-1\tS2-1,S2-1,S1-4,X9-1\nS1-1\t\nS1-9\t\nbroken\n", None)])
def test_validator(spark, tmp_path, text, fault):
    (tmp_path / "m.tsv").write_text(text)
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    errors, _ = validate.validate(spark, f"{tmp_path}/m.tsv", required)
    if fault:
        assert errors == [f"matching: {fault}"]
    else:
        assert errors == ["matching: malformed_row: 1", "matching: duplicate_row (1): S1-1", "matching: extra (1): S1-9", "matching: missing (1): S1-2", "matching: repeated_id (1): S1-1", "matching: self_match (1): S1-4", "matching: wrong_prefix (1): X9-1"]
    assert validate.validate(spark, f"{tmp_path}/none.tsv", required)[0] == ["matching: missing_file"]


def test_sources(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    gold, everyone = tables.load_gold(spark, f"{tmp_path}/g.tsv")
    assert kept(gold) == {("S1-1", "S2-1"), ("S1-1", "S3-1")} and everyone.count() == 2
    one = spark.createDataFrame([("s", "p", 0.5)], "s1_id string, pool_id string, ce_prob double")
    one.write.parquet(f"{tmp_path}/ce_test_part0.parquet")
    one.withColumn("ce_prob", F.lit(0.1)).union(one.withColumn("pool_id", F.lit("q"))).write.parquet(f"{tmp_path}/ce_test_contested_part0.parquet")
    assert {r["pool_id"]: r["ce_prob"] for r in tables.load_scores(spark, str(tmp_path), "test").collect()} == {"p": 0.5, "q": 0.5}
    assert tables.load_scores(spark, str(tmp_path), "none") is None
    one.withColumnRenamed("ce_prob", "prob").union(one.withColumn("ce_prob", F.lit(0.0001))).write.parquet(f"{tmp_path}/pairs")
    assert tables.read_pairs(spark, f"{tmp_path}/pairs").count() == 1


def test_incremental_cache(spark, tmp_path):
    from matchloom.streaming import incremental

    seen = []
    compute = lambda df: (seen.append(df.count()), df.withColumn("f", F.lit(1)))[1]
    p = pairs(spark, [("s", "a", 0.1), ("s", "b", 0.1)])
    incremental.extend_cache(spark, p.where("pool_id = 'a'"), f"{tmp_path}/c", compute)
    assert incremental.extend_cache(spark, p, f"{tmp_path}/c", compute).count() == 2 and seen == [1, 1]


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pair_features_against_plain(spark):
    """Every feature of a few pairs, from the views and the plain scorers."""
    import math

    from matchloom.functions import similarity as sm
    from matchloom.functions import text as tx
    from matchloom.operators import context, features

    rows = [
        ("S1-1", "Private Anand Foundation Ltd", "Flat No 243, Near SBI Bank, MG Road, Pune 411 001", 1),
        ("S1-2", "Allsun Allen", "18730 Little Lane, Austin TX 78701", 1),
        ("S2-1", "Anand Foundation Pvt Ltd (ID: 54473)", "Flat 243 nr SBI Bank MG Rd Pune", 2),
        ("S2-2", "Yumabrixveo fka Allsun Allen LLC", "1873 Little Ln Austin", 2),
        ("S3-1", "praaivett anand foundation limittedd", "", 3),
    ]
    records = tx.normalize(spark.createDataFrame([(*r, "x") for r in rows], "entity_id string, business_name string, business_address string, source int, country string"))
    views = {r["entity_id"]: r.asDict() for r in records.collect()}
    pairs = [(a, b, 0.1 * i, i + 1) for i, (a, b) in enumerate([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2"), ("S1-2", "S2-1")])]
    cands = context.global_context(spark.createDataFrame(pairs, "s1_id string, pool_id string, tok_score double, tok_rank int"))
    got = {(r["s1_id"], r["pool_id"]): r.asDict() for r in features.pair_features(cands, records, records).collect()}
    assert set(got) == {p[:2] for p in pairs}
    words = lambda s: {w for w in s.split(" ") if w}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    for (i, j), r in got.items():
        a, b = views[i], views[j]
        fuzzy = {
            "n_ratio": ("name_core", sm.ratio), "n_partial": ("name_core", sm.partial_ratio), "n_tsort": ("name_core", sm.token_sort_ratio), "n_tset": ("name_core", sm.token_set_ratio), "n_jw": ("name_core", sm.jaro_winkler), "n_clean_ratio": ("name_clean", sm.ratio),
            "n_skel_ratio": ("name_skel", sm.ratio), "n_skel_tset": ("name_skel", sm.token_set_ratio), "n_ns_ratio": ("name_ns", sm.ratio), "n_ns_partial": ("name_ns", sm.partial_ratio), "a_ratio": ("addr_clean", sm.ratio), "a_partial": ("addr_clean", sm.partial_ratio),
            "a_tset": ("addr_clean", sm.token_set_ratio), "a_tsort": ("addr_clean", sm.token_sort_ratio),
        }
        want = {n: score(a[v], b[v]) for n, (v, score) in fuzzy.items()}
        for name, view in (("n_skel", "name_skel"), ("a", "addr_clean"), ("num", "nums"), ("lm", "landmarks")):
            want |= {f"{name}_jac": jaccard(words(a[view]), words(b[view])), f"{name}_inter": len(words(a[view]) & words(b[view]))}
        nums, post = (words(a["nums"]), words(b["nums"])), (words(a["postal"]), words(b["postal"]))
        house = [next((w for w in x["addr_clean"].split() if w.isdigit()), "") for x in (a, b)]
        want |= {
            "n_exact": a["name_core"] == b["name_core"], "n_ns_eq": a["name_ns"] == b["name_ns"], "b_has_alt": b["name_alt"] != "", "n_alt_tset": sm.token_set_ratio(a["name_core"], b["name_alt"]) if b["name_alt"] else -1.0, "b_addr_empty": b["addr_clean"] == "",
            "num_both": all(map(bool, nums)), "num_conflict": all(map(bool, nums)) and not nums[0] & nums[1], "pc_jac": jaccard(*post), "pc_both": all(map(bool, post)), "house_eq": house[0] == house[1] if all(house) else -1, "source": b["source"],
            "len_name_a": len(a["name_core"]), "len_name_b": len(b["name_core"]), "len_addr_a": len(a["addr_clean"]), "len_addr_b": len(b["addr_clean"]), "name_addr": 0.6 * want["n_tset"] + 0.4 * want["a_tset"],
            "n_extra_b": len(words(b["name_skel"]) - words(a["name_skel"])), "n_extra_a": len(words(a["name_skel"]) - words(b["name_skel"])), "house_absdiff": math.log1p(abs(int(house[0][:9]) - int(house[1][:9]))) if all(house) else -1.0,
            "house_prefix": house[0] != house[1] and (house[0].startswith(house[1]) or house[1].startswith(house[0])) if all(house) else -1, "house_samelen": len(house[0]) == len(house[1]) if all(house) else -1,
        }
        assert {n: round(float(r[n]), 9) for n in want} == {n: round(float(v), 9) for n, v in want.items()}, (i, j)
    for score in ("name_addr", "n_tset", "a_tset", "n_skel_ratio", "tok_score"):
        for i in ("S1-1", "S1-2"):
            mine = [r for (a, _), r in got.items() if a == i]
            best = max(r[score] for r in mine)
            assert all(r[f"s1_gap_{score}"] == best - r[score] and r[f"s1_rank_{score}"] == 1 + sum(o[score] > r[score] for o in mine) for r in mine)


def test_scored_rows_teach_nothing(spark):
    """Out-of-fold and quarter scores of a fold do not change with that fold's own labels."""
    import zlib

    from matchloom.operators import learn

    rnd = random.Random(3)
    rows = [(f"S1-{i}", f"S2-{j}", rnd.random(), rnd.random()) for i in range(60) for j in range(4)]
    rows = [(*r, int(r[2] + 0.3 * r[3] > 0.7)) for r in rows]
    df = spark.createDataFrame(rows, "s1_id string, pool_id string, x double, y double, label int")
    small = {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1}

    def scores(done, name):
        return {(r["s1_id"], r["pool_id"]): r[name] for r in done.collect()}

    for n, fold_, score in ((2, 1, lambda d: scores(learn.out_of_fold(d, ["x", "y"], 2, early_stopping=False, **small)[0], "prob")), (20, 0, lambda d: scores(learn.quarter_stack(d, ["x", "y"], **small), "stack_prob"))):
        mine = {r[0] for r in rows if zlib.crc32(r[0].encode()) % n == fold_}
        turned = df.withColumn("label", F.when(F.col("s1_id").isin(*mine), 1 - F.col("label")).otherwise(F.col("label")))
        one, two = score(df), score(turned)
        assert one.keys() == two.keys() and mine & {k[0] for k in one}
        assert all(one[k] == two[k] for k in one if k[0] in mine) and any(one[k] != two[k] for k in one if k[0] not in mine)


def test_token_pass_makes_no_row_of_a_shared_word(spark, monkeypatch):
    """180 million shared words of 900,000 pairs, in tiles; names that two words share are told apart."""
    import time

    import numpy as np

    rnd = np.random.default_rng(8)
    vocabulary = np.array([f"w{i}" for i in range(900)])
    words = [vocabulary[np.sort(rnd.choice(900, 425, replace=False))].tolist() for _ in range(1900)]
    q = spark.createDataFrame([(i, "k", w) for i, w in enumerate(words[:900])], "s1_id long, country string, tokens array<string>")
    p = spark.createDataFrame([(f"p{i:04}", "k", w) for i, w in enumerate(words[900:])], "pool_id string, country string, tokens array<string>")
    name = blocking.word_name
    monkeypatch.setattr(blocking, "word_name", lambda word, seed: name(word, seed) if seed else F.length(word).cast("long"))
    monkeypatch.setattr(blocking, "TILE_WORDS", 150_000)
    monkeypatch.setattr(blocking, "TILE_QUERIES", 100)
    began = time.time()
    got = {(r["s1_id"], r["tok_rank"]): (r["pool_id"], r["tok_score"]) for r in blocking.token_pass(q, p, max_df=480).collect()}
    assert time.time() - began < 30
    has = np.array([np.isin(vocabulary, w) for w in words], float)
    df = has[900:].sum(0)
    has *= np.where(df <= 480, np.log1p(1000 / np.maximum(df, 1)), 0)
    assert 0 < (df > 480).sum() < 900
    has /= np.sqrt((has * has).sum(1, keepdims=True)) + 1e-6
    score = has[:900] @ has[900:].T
    for i in range(900):
        best = np.argsort(-np.round(score[i], 9), kind="stable")[:12]
        assert [got[i, k + 1][0] for k in range(12)] == [f"p{j:04}" for j in best] and np.allclose([got[i, k + 1][1] for k in range(12)], score[i][best], atol=1e-9)


def test_pairs_are_scored_by_all_cores(spark, tmp_path):
    """Few bytes with much work: parts are normalized, and pairs scored, by as many tasks as a shuffle has."""
    from matchloom.functions import similarity as sm
    from matchloom.plans import catalogue

    rows = [(i, "%s part" % w, "Brand#%d" % (i % 9), "LARGE", i % 50) for i, w in enumerate(["hot", "cold", "old"] * 200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    s1, _ = catalogue.entities(spark, str(tmp_path))
    assert len(s1.inputFiles()) >= 4
    got = catalogue.pair_features(spark, str(tmp_path)).select("s1_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["s1_id"] for r in got}) == len(got) == 200 and len({r["task"] for r in got}) >= 4

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 12))) for _ in "ab")
        assert sm.lcs_length(a, b) == plain(a, b)
        a, b = sorted((a, b), key=len)
        stretches = [b[max(0, e - len(a)) : e] for e in range(1, len(b) + len(a))]
        ratios = [(2 * plain(a, s) / (len(a) + len(s)), s) for s in stretches]
        assert max(r for r, s in ratios if s[0] in a or s[-1] in a or not r) <= sm.partial_ratio(a, b) <= max(ratios)[0]


def test_blocks_are_looked_up_without_dealing_records(spark):
    """Queries of unseen blocks share the whole pool once; no record's words are shuffled by block to find that out."""
    q = spark.createDataFrame([("s", "k", ["a", "b"]), ("t", "x", ["a"]), ("u", "y", ["b", "b", None]), ("v", None, ["c"]), ("w", "x", None)], "s1_id string, country string, tokens array<string>")
    pool = spark.createDataFrame([("p1", "k", ["a"]), ("p2", "l", ["b"]), ("p3", None, ["c"]), ("p4", "l", None)], "pool_id string, country string, tokens array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        plans = [df._jdf.queryExecution().toString() for df in blocking.blocks_or_all(q, pool, "country")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("SortMergeJoin" in p.split("== Physical Plan ==")[1] for p in plans)
    assert kept(blocking.token_pass(q, pool)) == {("s", "p1"), ("t", "p1"), ("u", "p2"), ("v", "p3")}


def test_token_pass_reads_a_record_of_two_blocks_once(spark):
    """A record's words are made once for the vocabulary and once for the tiles, also where the whole pool is a block."""
    from collections import Counter

    import numpy as np

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(i):
        made.add(1)
        return [f"w{i % 40}", f"v{i % 7}", f"u{i % 3}"]

    q = spark.createDataFrame([("s", "k", ["w1", "v1"]), ("t", "unseen", ["w2", "v3"])], "s1_id string, country string, tokens array<string>")
    plain = spark.range(600).select(F.col("id").alias("pool_id"), F.when(F.col("id") % 9 > 0, F.lit("k")).alias("country"))
    got = blocking.token_pass(q, plain.withColumn("tokens", tokens("pool_id")), k=300).collect()
    assert made.value <= 2 * 600  # four times each before
    words = {i: {f"w{i % 40}", f"v{i % 7}", f"u{i % 3}"} for i in range(600)}
    few = blocking.token_pass(q, plain.withColumn("tokens", tokens("pool_id")), k=5).collect()
    for s1, mine, block in (("s", {"w1", "v1"}, [i for i in words if i % 9]), ("t", {"w2", "v3"}, list(words))):
        df = Counter(w for i in block for w in words[i])
        square = lambda some: sum(np.log1p(len(block) / df[w]) ** 2 for w in some)  # noqa: E731,B023
        score = {i: square(mine & words[i]) / ((square(mine) ** 0.5 + 1e-6) * (square(words[i]) ** 0.5 + 1e-6)) for i in block if mine & words[i]}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))
        for rows, k in ((got, 300), (few, 5)):
            assert [r["pool_id"] for r in sorted((r for r in rows if r["s1_id"] == s1), key=lambda r: r["tok_rank"])] == want[:k]
