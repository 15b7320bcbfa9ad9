"""The stages and commands over a small set of records, from files to a checked answer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import decide, learn
from matchloom.plans import commands, pipeline
from matchloom.sources import tables

SMALL = {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1}
GIVEN = {
    "S1-000001": ("Private Anand Foundation Ltd", "Flat No 243, Near SBI Bank, MG Road, Pune 411 001", "India"),
    "S1-000010": ("Allsun Allen", "18730 Little Lane, Austin TX 78701", "US"),
    "S1-000123": ("Boulangerie Lefevre SARL", "12 Rue de la Paix, Lille 59000", "France"),
    "S2-000001": ("Anand Foundation Pvt Ltd (ID: 54473)", "Flat 243 nr SBI Bank MG Rd Pune", "India"),
    "S2-000002": ("Yumabrixveo fka Allsun Allen, DO", "1873 Little Ln Austin", "US"),
    "S3-000001": ("praaivett anand foundation limittedd", "", "India"),
    "S3-000002": ("www.allsunallen.com", "18730 LITTLE LN, AUSTIN", "US"),
}
GOLD = {"S1-000001": ["S2-000001", "S3-000001"], "S1-000010": ["S3-000002"], "S1-000123": []}


def made_records(seed, n=50):
    """Records with copies in both pool sources, some without, some look-alikes; and what belongs together."""
    rnd = random.Random(seed)
    parts = [a + b for a in ("mar", "tel", "nor", "gal", "pin", "sol", "ber", "kas") for b in ("to", "vian", "dex", "mira", "ling", "bo")]
    records, gold = dict(GIVEN), {k: list(v) for k, v in GOLD.items()}
    for i in range(n):
        country = "India" if i % 2 else "US"
        name = " ".join(rnd.sample(parts, 2))
        address = f"{rnd.randint(1, 999)} {rnd.choice(parts)} road {rnd.choice(parts)}"
        s1 = f"S1-{1000 + i:06d}"
        records[s1] = (f"{name} Ltd", address, country)
        gold[s1] = []
        if i % 7:
            for k in (2, 3)[: 1 + i % 2]:
                other = f"S{k}-{1000 + i:06d}"
                records[other] = (name.upper() + " limited" if k == 2 else name.replace("a", "aa", 1), address if i % 5 else "", country)
                gold[s1].append(other)
        records[f"S2-{5000 + i:06d}"] = (f"{name.split()[0]} {rnd.choice(parts)}", f"{rnd.randint(1, 999)} {address.split(' ', 1)[1]}", country)
    return records, gold


def write_split(folder, split, records, gold):
    (folder / split).mkdir(parents=True)
    for k in (1, 2, 3):
        lines = ["\t".join((i, *r)) for i, r in records.items() if i.startswith(f"S{k}-")]
        (folder / split / f"{split}_source{k}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *lines]) + "\n")
    if split == "train":
        (folder / split / "train_ground_truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *(f"{s}\t{','.join(m)}" for s, m in gold.items())]) + "\n")


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    for split, seed in (("train", 1), ("test", 2)):
        write_split(root / "dataset", split, *made_records(seed))
    config = {"data_dir": f"{root}/dataset", "work_dir": f"{root}/work", "out_dir": f"{root}/output", "folds": 2, "learner": SMALL}
    (root / "config.json").write_text(json.dumps(config))
    cfg = pipeline.Config.read(f"{root}/config.json")
    return root, cfg, pipeline.run(spark, cfg, "train"), pipeline.run(spark, cfg, "test")


def answered(spark, path):
    return {r[0]: (r[1] or "").split(",") if r[1] else [] for r in spark.read.options(sep="\t", header=True).csv(path).collect()}


def test_train_and_test(spark, ran):
    root, cfg, train, test = ran
    assert 0.9 < train["block"]["recall_tok"] == train["block"]["recall_union"] <= 1 and train["block"]["oracle_f05"] > 0.9
    assert train["rank"]["stage"] == (2 if learn.accepted(train["rank"]["first"], train["rank"]["second"]) else 1)
    assert test["decide"]["errors"] == [] and test["decide"]["warnings"] == [] and test["decide"]["records"] == 53
    _, gold = made_records(2)
    got = answered(spark, f"{root}/output/test/matching_results.tsv")
    right, said = sum(len(set(got[s]) & set(m)) for s, m in gold.items()), sum(map(len, got.values()))
    assert set(got) == set(gold) and right / said > 0.8 and right / sum(map(len, gold.values())) > 0.6
    cands = answered(spark, f"{root}/output/test/candidate_pairs.tsv")
    assert all(set(m) <= set(cands[s]) for s, m in got.items())
    # the unseen country's record is compared with the whole pool
    assert tables.load_normalized(spark, cfg.at("test", ""))[0].where("country_norm = 'france'").count() == 1


def test_answer_is_in_the_order_of_the_file(spark, ran):
    root, cfg, _, _ = ran
    lines = [p.read_text().splitlines()[1:] for p in sorted((root / "output/test/matching_results.tsv").glob("part-*"))]
    ids = [line.split("\t")[0] for part in lines for line in part]
    assert ids == [i for i in made_records(2)[0] if i.startswith("S1-")]


def test_resumed_run_keeps_tables(spark, ran):
    from dataclasses import replace

    _, cfg, _, _ = ran
    mark = lambda: sorted((p.name, p.stat().st_mtime_ns) for p in __import__("pathlib").Path(cfg.at("test", "cands.parquet")).glob("part-*"))
    before = mark()
    pipeline.run(spark, replace(cfg, resume=True), "test", ("normalize", "block", "features"))
    assert mark() == before


def two_letter_vectors(text):
    """A stand-in for an encoder: counts of four letters, scaled to length 1."""
    counts = F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) + F.lit(0.1) for c in "aeio"])
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: (x / norm).cast("float"))


def test_embedding_pass(spark, ran, tmp_path):
    from dataclasses import replace
    from shutil import copytree

    _, cfg, _, _ = ran
    copytree(cfg.work_dir, tmp_path / "work")
    cfg = replace(cfg, work_dir=f"{tmp_path}/work")
    assert pipeline.embedder(f"{__name__}:two_letter_vectors").__name__ == "two_letter_vectors" and pipeline.embedder(None) is None
    told = pipeline.run(spark, cfg, "train", ("embed", "block", "features"), two_letter_vectors)
    assert set(told["block"]) == {"recall_tok", "recall_emb", "recall_union", "oracle_f05"} and told["block"]["recall_union"] >= told["block"]["recall_tok"] - 0.05
    feats = spark.read.parquet(cfg.at("train", "feats.parquet"))
    assert {"emb_score", "emb_rank", "s1_rank_emb_score", "s1_gap_emb_score", "cand_rank_emb_score", "cand_gap_emb_score"} <= set(feats.columns)
    assert feats.where("emb_rank < 999").count() > 0 and len(feats.columns) == 75


def test_validator_command(spark, ran, capsys):
    root, _, _, _ = ran
    given = ["validate", "--test-dir", f"{root}/dataset/test", "--matching", f"{root}/output/test/matching_results.tsv", "--candidate", f"{root}/output/test/candidate_pairs.tsv", "--check-ids"]
    assert commands.main(given) == 0 and "sound" in capsys.readouterr().out
    bad = root / "bad.tsv"
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-000001\tS2-000001,S2-000001,S1-000010,S2-999999,X1\nS1-000001\t\nS1-777777\t\n")
    errors, _ = commands.check_answer(spark, str(bad), f"{root}/dataset/test", check_ids=True)
    kinds = {e.split(": ")[1].split(" ")[0] for e in errors}
    assert kinds == {"duplicate_row", "extra", "missing", "repeated_id", "self_match", "unknown_id", "wrong_prefix"}
    assert commands.main(["validate", "--test-dir", f"{root}/dataset/test", "--matching", str(bad)]) == 1
    errors, warnings = commands.check_answer(spark, f"{root}/none.tsv", f"{root}/dataset/test", f"{root}/none2.tsv")
    assert errors == ["matching: missing_file"] and len(warnings) == 1


def test_experiments(spark, ran, capsys):
    root, cfg, _, _ = ran
    told = commands.experiment(spark, cfg, "base", maxIter=2)
    assert told["macro_f05"] <= told["ceiling"] <= 1 and set(told["by_country"]) <= {"india", "us", "france"} and 1 <= told["trees"] <= 2
    lost = sum(r["points_lost"] for r in told["losses"])
    assert abs(told["macro_f05"] - (1 - lost)) < 1e-9
    pairs = commands.left_out_country(spark, cfg, "loco", maxIter=1)["pairs"]
    assert {(p["train"], p["test"]) for p in pairs} >= {("india", "us"), ("us", "india")} and all(p["transfer"] <= p["tuned_there"] + 1e-9 for p in pairs)
    log = spark.read.json(f"{cfg.work_dir}/experiments")
    assert log.count() == 2 and "git_hash" in log.columns


def test_ablation_curve_and_sets(spark, ran):
    _, cfg, _, _ = ran
    told = commands.ablation(spark, cfg, maxIter=1)
    assert set(told) == {"with", "without"}
    curve = commands.learning_curve(spark, cfg, (0.5, 1.0), maxIter=1)
    assert [c["share"] for c in curve] == [0.5, 1.0] and curve[0]["records"] < curve[1]["records"]
    sets = commands.feature_sets(spark, cfg, "india", "us", shifts=(0.0,), maxIter=1)
    assert [s["run"] for s in sets] == ["reference", "india: all", "india: no_emb", "india: no_country", "india: neutral"] and sets[0]["features"] > sets[-1]["features"]


@pytest.fixture(scope="module")
def scored(spark, ran, tmp_path_factory):
    """Scores of a second model for both splits, under the names that folders of scores have."""
    root, cfg, _, _ = ran
    folder = tmp_path_factory.mktemp("scores")
    gold, _ = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    train = spark.read.parquet(cfg.at("train", "oof.parquet")).select("s1_id", "pool_id", F.greatest("prob", F.lit(0.01)).alias("prob"))
    train = train.join(gold.withColumn("label", F.lit(1)), ["s1_id", "pool_id"], "left").fillna(0, ["label"])
    test = spark.read.parquet(cfg.at("test", "probs_default.parquet")).select("s1_id", "pool_id", F.greatest("prob", F.lit(0.01)).alias("prob"))
    noise = F.pmod(F.xxhash64("s1_id", "pool_id"), F.lit(100)) / 1000
    for kind, df in (("oof_fold0", train), ("test", test)):
        df.select("s1_id", "pool_id", (0.8 * F.col("prob") + noise).alias("ce_prob")).write.parquet(f"{folder}/ce_{kind}_part0.parquet")
    train.write.parquet(f"{folder}/train.parquet")
    test.write.parquet(f"{folder}/test.parquet")
    return folder


def test_blend_commands(spark, ran, scored):
    root, cfg, _, _ = ran
    config = ["--config", f"{root}/config.json"]
    told = commands.blend_eval(spark, cfg, spark.read.parquet(f"{scored}/train.parquet"), tables.load_scores(spark, str(scored), "oof_fold0"), ("ce", "logit"), (0.5,))
    assert {t["blend"] for t in told} == {"ce", "logit"}
    out = f"{root}/output/blend"
    assert commands.main(["blend-submit", *config, "--pairs", f"{scored}/test.parquet", "--ce", str(scored), "--blend", "logit", "--w", "0.5", "--params", '{"method": "expf", "alpha": 1.5}', "--out", out, "--shift", "us:-0.5"]) == 0
    assert commands.check_answer(spark, f"{out}/matching_results.tsv", f"{root}/dataset/test")[0] == []
    with pytest.raises(ValueError, match="lack"):
        few = spark.read.parquet(f"{scored}/ce_test_part0.parquet").limit(1)
        commands.blend_submit(spark, cfg, spark.read.parquet(f"{scored}/test.parquet"), few, "logit", 0.5, decide.Params(), out)
    assert commands.main(["ce-average", *config, "--member", str(scored), "--member", str(scored), "--kind", "test", "--out", f"{root}/mean"]) == 0
    same = spark.read.parquet(f"{root}/mean/ce_test_part0.parquet").join(spark.read.parquet(f"{scored}/ce_test_part0.parquet").withColumnRenamed("ce_prob", "x"), ["s1_id", "pool_id"])
    assert same.where("abs(ce_prob - x) > 1e-5").count() == 0 and same.count() > 0


def test_stacker_commands(spark, ran, scored):
    root, cfg, _, _ = ran
    pairs = spark.read.parquet(f"{scored}/train.parquet").withColumnRenamed("prob", "lgbm_prob")
    ce = tables.load_scores(spark, str(scored), "oof_fold0")
    told = commands.stack_eval(spark, cfg, pairs, {"ce": ce}, ("meta",), maxIter=1, maxDepth=2, minInstancesPerNode=1)
    assert told[0]["features"] == "meta" and 0 <= told[0]["macro_f05"] <= 1
    table, columns = commands.stacker_table(spark, cfg, pairs, pairs, "train", {"ce": ce}, meta=True, raw=True)
    assert {"b_empty_addr", "b_source", "len_name_a", "len_addr_b", "r_name_tset", "pool_margin", "blend", "ctx_lgbm_rank", "ce_prob"} <= set(columns) and not {"label", "lgbm_prob", "s1_id"} & set(columns)
    row = table.where("s1_id = 'S1-000001' and pool_id = 'S3-000001'").first()
    assert (row["b_empty_addr"], row["b_source"], row["len_addr_b"], row["len_name_b"]) == (1.0, 1.0, 0.0, 36.0)
    out, test = f"{root}/output/stack", spark.read.parquet(f"{scored}/test.parquet").withColumnRenamed("prob", "lgbm_prob")
    scores = {"ce": tables.load_scores(spark, str(scored), "test")}
    told = commands.stack_submit(spark, cfg, pairs, test, {"ce": ce}, scores, out, unseen_mix="ce:0.3,0.6", swap=("ce", scores["ce"]), unseen_prob=test.select("s1_id", "pool_id", F.lit(0.5).alias("prob")), maxIter=1, maxDepth=2, minInstancesPerNode=1)
    assert set(told) == {f"{out}_mix0.3", f"{out}_mix0.6"} and all(t["errors"] == [] for t in told.values())
    told = commands.proxy_eval(spark, cfg, pairs, {"ce": ce}, "india", "us", ((), ("meta",)), (0.0, -1.0), maxIter=1, maxDepth=2, minInstancesPerNode=1)
    assert [(t["drop"], t["shift"]) for t in told] == [([], 0.0), ([], -1.0), (["meta"], 0.0), (["meta"], -1.0)] and told[0]["features"] == told[2]["features"] + 5


def test_reports(spark, ran, scored, capsys):
    root, cfg, _, _ = ran
    told = commands.eda(spark, cfg)
    assert told["same_country"] == 1.0 and told["violations"] == 0 and sum(told["matches"].values()) == 53
    told = commands.blocking_eval(spark, cfg, caps=(1, 20))
    assert told["caps"][1]["recall"] < told["caps"][20]["recall"] and told["caps"][1]["pairs"] <= 53
    pairs = spark.read.parquet(f"{scored}/train.parquet")
    told = commands.decision_eval(spark, cfg, pairs, "us")
    assert set(told["rules"]) == {"expf", "exact"} and told["assigned"][1.01] <= 1 and 0.0 in told["shifted"]
    told = commands.error_analysis(spark, cfg, pairs, 2)
    assert all(r["kind"] != "ok" for r in told["losses"]) and {"tp", "fp", "fn", "precision", "recall"} <= set(told["pairs"])
    assert told and commands.main(["diff", "--config", f"{root}/config.json", "--a", f"{root}/output/test/matching_results.tsv", "--b", f"{root}/output/test/matching_results.tsv"]) == 0
    assert "us" in capsys.readouterr().out


def test_package(spark, ran, tmp_path):
    import zipfile

    root, _, _, _ = ran
    note = tmp_path / "note.md"
    note.write_text("x")
    given = ["package", "--team", "t", "--answer", f"{root}/output/test", "--out-dir", str(tmp_path), "--file", str(note)]
    assert commands.main(given) == 0
    with zipfile.ZipFile(tmp_path / "t_submission.zip") as z:
        assert sorted(z.namelist()) == ["note.md", "output/candidate_pairs.tsv", "output/matching_results.tsv"]
        lines = z.read("output/matching_results.tsv").decode().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and len(lines) == 54
    with pytest.raises(FileNotFoundError, match="none.md"):
        commands.package({"a": "none.md"}, str(tmp_path / "u.zip"))
    assert not (tmp_path / "u.zip").exists()


def test_command_line(spark, ran):
    root, _, _, _ = ran
    assert pipeline.main(["--stage", "decide", "--split", "test", "--config", f"{root}/config.json"]) == 0
