"""Commands beside the stages: checks, experiments, blends, stackers and reports over the stages' tables.

python -m matchloom.plans.commands <command> [--config config.json] ...

Every command is a function of a session and a configuration that returns what it found; the command line prints it.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import shutil
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import fold
from ..operators import blends, blocking, decide, features, folds, learn, metrics, validate
from ..sources import sinks, tables
from . import pipeline, reports
from .pipeline import Config

KEYS = list(pipeline.ID_COLUMNS)
#: What the experiments decide with when nothing is tuned.
USUAL = decide.Params("expf", alpha=1.5)


def _of_country(spark: SparkSession, cfg: Config, split: str = "train") -> DataFrame:
    return pipeline.records(spark, cfg, split).select("s1_id", "country")


def _macro(pairs: DataFrame, gold: DataFrame, ids: DataFrame, params: decide.Params = USUAL) -> float:
    return metrics.f05_by_entity(decide.decide(pairs, params), gold, ids).agg(F.avg("f05")).first()[0]


def _within(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("s1_id"), "s1_id", "left_semi")


def _params(best) -> decide.Params:
    return decide.Params(best["method"], best["t"] or 0.0, best["r"] or 0.0, best["alpha"] or 0.0, best["one_to_one"])


# --- checks


def check_answer(spark: SparkSession, matching: str, test_dir: str, candidate: str | None = None, check_ids: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings) of answer files against the records of a test folder."""
    required = tables.read_ids(spark, f"{test_dir}/test_source1.tsv").withColumnRenamed("id", "s1_id")
    targets, warnings = None, []
    if check_ids:
        targets = tables.match_targets(spark, test_dir)
        warnings += ["ids are not checked: a pool source is missing"] if targets is None else []
    if candidate is not None and not tables._exists(spark, candidate):
        warnings.append(f"{candidate} is missing: candidates are not checked")
        candidate = None
    errors, more = validate.validate(spark, matching, required, candidate, targets)
    return errors, warnings + more


# --- experiments over the training features


def _fitted(train: DataFrame, stop: DataFrame, columns: list[str], settings: dict):
    """A model whose boosting the second table stops."""
    both = train.withColumn("_stop", F.lit(False)).unionByName(stop.withColumn("_stop", F.lit(True)))
    return learn.fit(both, columns, validation="_stop", **settings)


def experiment(spark: SparkSession, cfg: Config, tag: str, drop: tuple[str, ...] = (), **settings) -> dict:
    """Folds 1 to 4 fitted, fold 0 scored: macro F0.5 overall and by country, log loss, where score is lost, the
    ceiling that blocking sets, the leading features. Fold 0's scores stay as a table, a line goes to the log."""
    labelled, columns, gold, ids = pipeline.labelled_features(spark, cfg)
    columns, settings = [c for c in columns if c not in drop], {**cfg.learner, **settings}
    held_out = fold(F.col("s1_id"), 5) == 0
    model = _fitted(labelled.where(~held_out), labelled.where(held_out), columns, settings)
    at = f"{cfg.work_dir}/exp/preds_{tag}.parquet"
    sinks.write_stage(learn.predict(model, labelled.where(held_out), columns).select(*KEYS, "label", "prob"), at, by="s1_id")
    scored, val = spark.read.parquet(at), ids.where(held_out).join(_of_country(spark, cfg), "s1_id", "left")
    gold = _within(gold, val)
    best = decide.best_setting(decide.tune(scored, gold, val)).first()
    pred = decide.decide(scored, _params(best))
    kinds = metrics.loss_kinds(pred, gold, val, scored)
    out = {
        "tag": tag, "features": len(columns), "trees": model.getNumTrees, "macro_f05": best["macro_f05"], "decision": str(_params(best)),
        "by_country": {r["country"]: r["macro_f05"] for r in metrics.score_by(pred, gold, val, "country").collect()},
        "logloss": metrics.auc(scored, "prob", "label").first()["logloss"], "ceiling": metrics.oracle_f05(scored, gold, val).first()["oracle_f05"],
        "losses": [r.asDict() for r in metrics.loss_decomposition(kinds).orderBy(F.desc("loss")).collect()], "top": learn.importance([model], columns),
    }
    sinks.append_log(spark, f"{cfg.work_dir}/experiments", change=f"{tag} (fold0)", val_macro_f05=out["macro_f05"], notes=f"{len(columns)} features {json.dumps(settings, sort_keys=True)}")
    return out


def left_out_country(spark: SparkSession, cfg: Config, tag: str, drop: tuple[str, ...] = (), **settings) -> dict:
    """Each country's model on each other country's fold 0: decided as tuned at home (transfer), and as tuned there."""
    labelled, columns, gold, ids = pipeline.labelled_features(spark, cfg)
    columns, settings = [c for c in columns if c not in drop], {**cfg.learner, **settings}
    dim = ids.join(_of_country(spark, cfg), "s1_id")
    labelled, held_out = labelled.join(dim, "s1_id"), fold(F.col("s1_id"), 5) == 0
    names = sorted(r["country"] for r in dim.where(held_out).select("country").distinct().collect())  # one row for each country
    rows = []
    for home in names:
        mine = labelled.where(F.col("country") == home)
        model = _fitted(mine.where(~held_out), mine.where(held_out), columns, settings)
        for there in names:
            val = dim.where(held_out & (F.col("country") == there))
            scored = learn.predict(model, _within(labelled, val), columns).select(*KEYS, "prob")
            best = decide.best_setting(decide.tune(scored, _within(gold, val), val)).first()
            rows.append((home, there, scored, val, _params(best), best["macro_f05"]))
    at_home = {home: params for home, there, _, _, params, _ in rows if home == there}
    found = [{"train": h, "test": t, "transfer": _macro(s, _within(gold, v), v, at_home[h]), "tuned_there": m} for h, t, s, v, _, m in rows]
    others = [f["transfer"] for f in found if f["train"] != f["test"]]
    loco = sum(others) / len(others) if others else None
    sinks.append_log(spark, f"{cfg.work_dir}/experiments", change=f"{tag} (loco)", loco_f05=loco, notes=f"{len(columns)} features")
    return {"pairs": found, "loco": loco}


def ablation(spark: SparkSession, cfg: Config, group: str = "decoy", **settings) -> dict:
    """Fold 0 with and without a group of features, or with all but a list of them."""
    names = features.GROUPS.get(group) or group.split(",")
    return {name: {k: one[k] for k in ("macro_f05", "logloss", "trees")} for name, drop in (("without", tuple(names)), ("with", ())) for one in [experiment(spark, cfg, f"ablation_{group}_{name}", drop, **settings)]}


def feature_sets(spark: SparkSession, cfg: Config, home: str, away: str, shifts=(-1.0, -0.5, 0.0, 0.5), **settings) -> list[dict]:
    """What of the loss on an unseen country comes from features of the country: models of named sets of features fitted
    on one country, scored on half of another, beside a model of that country's other half."""
    labelled, columns, gold, ids = pipeline.labelled_features(spark, cfg)
    dim = ids.join(_of_country(spark, cfg), "s1_id")
    labelled, half = labelled.join(dim, "s1_id"), fold(F.col("s1_id"), 2)
    test = dim.where((F.col("country") == away) & (half == 0))
    left = lambda *groups: [c for c in columns if not any(c in features.GROUPS[g] for g in groups)]
    sets = {"all": columns, "no_emb": left("emb"), "no_country": left("country"), "neutral": left("emb", "country", "meta")}
    runs = [("reference", (F.col("country") == away) & (half == 1), "all")] + [(f"{home}: {k}", F.col("country") == home, k) for k in sets]
    out, stop = [], fold(F.col("s1_id"), 10) == 3
    for name, rows, chosen in runs:
        train = labelled.where(rows)
        model = _fitted(train.where(~stop), train.where(stop), sets[chosen], {**cfg.learner, **settings})
        scored = learn.predict(model, _within(labelled, test), sets[chosen]).select(*KEYS, "label", "prob")
        moved = {d: scored.withColumn("prob", blends.shifted(F.col("prob"), d)) for d in shifts}
        out.append({"run": name, "features": len(sets[chosen]), "auc": metrics.auc(scored, "prob", "label").first()["auc"], "by_shift": {d: _macro(m, _within(gold, test), test) for d, m in moved.items()}})
    return out


def learning_curve(spark: SparkSession, cfg: Config, shares=(0.125, 0.25, 0.5, 1.0), **settings) -> list[dict]:
    """Fold 0's macro F0.5 as the training records grow; smaller samples are within larger ones."""
    labelled, columns, gold, ids = pipeline.labelled_features(spark, cfg)
    held_out = fold(F.col("s1_id"), 5) == 0
    val, out = ids.where(held_out), []
    for share, sample in reports.learning_samples(ids.where(~held_out), shares).items():
        model = _fitted(_within(labelled, sample), labelled.where(held_out), columns, {**cfg.learner, **settings})
        scored = learn.predict(model, labelled.where(held_out), columns).select(*KEYS, "prob")
        best = decide.best_setting(decide.tune(scored, _within(gold, val), val)).first()
        out.append({"share": share, "records": sample.count(), "macro_f05": best["macro_f05"]})
    return out


# --- blends


def _scores(spark: SparkSession, folder: str, kind: str, name: str = "ce_prob") -> DataFrame:
    found = tables.load_scores(spark, folder, kind)
    if found is None:
        raise FileNotFoundError(f"no scores of kind {kind} in {folder}")
    return found.withColumnRenamed("ce_prob", name)


def blend_eval(spark: SparkSession, cfg: Config, pairs: DataFrame, scores: DataFrame, ways=("ce", "prob", "logit"), weights=(0.3, 0.5, 0.7)) -> list[dict]:
    """Cross-fitted macro F0.5 of blends on fold 0. pairs: s1_id, pool_id, prob; scores: s1_id, pool_id, ce_prob."""
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    dim = everyone.join(_of_country(spark, cfg), "s1_id")
    out = []
    for how in ways:
        for w in weights if how != "ce" else (1.0,):
            mixed = blends.blend(pairs, scores, how, w, missing_most=1.0)
            for r in reports.cross_fitted(mixed, gold, dim).collect():
                out.append({"blend": how, "w": w, "country": r["country"], "macro_f05": r["macro_f05"], "n": r["n"]})
    return out


def blend_submit(spark: SparkSession, cfg: Config, pairs: DataFrame, scores: DataFrame, how: str, w: float, params: decide.Params, out: str, shift: str = "") -> dict:
    """The answer of a blend of test scores; raises if too many pairs lack the second score. shift: country:delta."""
    mixed = blends.blend(pairs, scores, how, w)
    if shift:
        (mixed,) = blends.shift_variants(mixed, pipeline.records(spark, cfg), shift).values()
    told = pipeline.answer(spark, cfg, mixed.select(*KEYS, "prob"), params, out)
    sinks.write_note(spark, f"{out}/blend", blend=how, w=w, decision=str(params), shift=shift)
    return told


# --- stackers


def _filled(df: DataFrame, names: list[str], fill: list[str], missing: str) -> DataFrame:
    """Scores made whole: by the fill rules, else by zero or by the base model's score."""
    told = {f.split("=")[0] for f in fill}
    for n in names:
        if n.removesuffix("_prob") not in told:
            df = df.withColumn(n, F.coalesce(n, F.lit(0.0) if missing == "zero" else F.col("lgbm_prob")))
    return blends.fill(df, fill)


def stacker_table(spark: SparkSession, cfg: Config, pairs: DataFrame, all_pairs: DataFrame, split: str, scores: dict[str, DataFrame], fill=(), missing: str = "zero", meta: bool = False, raw: bool = False) -> tuple[DataFrame, list[str]]:
    """Pairs with all features of the stacker, and the features' names.

    pairs, all_pairs: s1_id, pool_id, lgbm_prob; scores: tables s1_id, pool_id, <name>_prob by name, `ce` among them.
    """
    for name, table in scores.items():
        pairs = pairs.join(table.select(*KEYS, f"{name}_prob"), KEYS, "left")
    pairs = _filled(pairs, [f"{n}_prob" for n in scores], list(fill), missing)
    before = set(pairs.columns) - {f"{n}_prob" for n in scores}
    out = blends.stack_features(pairs, all_pairs, tuple(n for n in scores if n != "ce"))
    s1, pool = tables.load_normalized(spark, cfg.at(split, ""))
    out = blends.record_features(out, s1, pool, meta)
    if raw:
        out = out.join(features.raw_features(out, s1, pool), KEYS, "left")
    return out, [c for c in out.columns if c not in before]


def stack_eval(spark: SparkSession, cfg: Config, pairs: DataFrame, scores: dict[str, DataFrame], sets=("pool", "meta"), alpha: float = 1.5, **settings) -> list[dict]:
    """Stackers compared on the quarters of fold 0, each pair scored by models of other quarters: macro F0.5 overall and
    by country, area under the curve and log loss, for each set of features. pairs: s1_id, pool_id, lgbm_prob, label."""
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    quarters = fold(F.col("s1_id"), 20).isin(0, 5, 10, 15)
    dim = everyone.where(quarters).join(_of_country(spark, cfg), "s1_id")
    out = []
    for name in sets:
        table, columns = stacker_table(spark, cfg, pairs.where(quarters), pairs, "train", scores, meta=name == "meta", raw=name == "raw")
        at = f"{cfg.work_dir}/exp/stack_{name}.parquet"
        sinks.write_stage(learn.quarter_stack(table, columns, **settings).select(*KEYS, "label", F.col("stack_prob").alias("prob")), at, by="s1_id")
        done = spark.read.parquet(at)
        pred = decide.decide(done, decide.Params("expf", alpha=alpha))
        by = {r["country"]: r["macro_f05"] for r in metrics.score_by(pred, gold, dim, "country").collect()}
        out.append({"features": name, "n": len(columns), "macro_f05": _macro(done, gold, dim, decide.Params("expf", alpha=alpha)), "by_country": by} | metrics.auc(done, "prob", "label").first().asDict())
    return out


def stack_submit(
    spark: SparkSession, cfg: Config, train: DataFrame, test: DataFrame, train_scores: dict[str, DataFrame], test_scores: dict[str, DataFrame], out: str, alpha: float = 1.5, meta: bool = False, raw: bool = False, fill=(), missing: str = "zero",
    swap: tuple[str, DataFrame] | None = None, unseen_prob: DataFrame | None = None, shift: str = "", unseen_mix: str = "", s1_from: DataFrame | None = None, **settings,
) -> dict[str, dict]:
    """A stacker fitted on fold 0, refitted on all of it, and its answers for the test split, by folder.

    train: s1_id, pool_id, lgbm_prob, label; test: without the label. swap: (name, table) whose scores stand in on
    records of unseen countries; unseen_prob: final scores of such records, pairs of its own included. shift:
    country:d1,d2 and unseen_mix: name:w1,w2 give one answer for each value.
    """
    first = train.where(fold(F.col("s1_id"), 5) == 0)
    first = _within(first, s1_from.distinct()) if s1_from is not None else first
    fitted, columns = stacker_table(spark, cfg, first, train.drop("label"), "train", train_scores, fill, missing, meta, raw)
    model = learn.fit_and_refit(fitted, columns, **settings)
    dim = _of_country(spark, cfg, "test")
    unseen = blends.unseen_entities(dim, _of_country(spark, cfg))
    if swap:
        name, table = swap
        test_scores = test_scores | {name: blends.swap_unseen(test_scores[name], table, unseen, f"{name}_prob")}
    scored, _ = stacker_table(spark, cfg, test, test, "test", test_scores, fill, "lgbm", meta, raw)
    at = f"{cfg.work_dir}/test/stack_{out.strip('/').replace('/', '_')}.parquet"
    sinks.write_stage(learn.predict(model, scored, columns).select(*KEYS, *[f"{n}_prob" for n in test_scores], "prob"), at, by="s1_id")
    done = spark.read.parquet(at)
    final = done.select(*KEYS, "prob") if unseen_prob is None else blends.override_append(done, unseen_prob.dropDuplicates(KEYS), unseen)
    answers = {out: final}
    if shift:
        moved = blends.shift_variants(final, dim, shift)
        answers = {out if len(moved) == 1 else f"{out}_s{d}": df for d, df in moved.items()}
    if unseen_mix:
        name, weights = unseen_mix.split(":")
        other = done.select(*KEYS, F.col(f"{name}_prob").alias("prob"))
        answers = {f"{out}_mix{w}": blends.mix_unseen(final, other, unseen, float(w)) for w in weights.split(",")}
    told = {}
    for folder, pairs in answers.items():
        told[folder] = pipeline.answer(spark, cfg, pairs, decide.Params("expf", alpha=alpha), folder, extra=pairs)
        sinks.write_note(spark, f"{folder}/blend", model="stack", features=len(columns), trees=model.getNumTrees, alpha=alpha, shift=shift, unseen_mix=unseen_mix)
    return told


def proxy_eval(spark: SparkSession, cfg: Config, pairs: DataFrame, scores: dict[str, DataFrame], seen: str, unseen: str, drops=((), ("meta",), ("country",)), shifts=(-2.0, -1.5, -1.0, -0.5, 0.0, 0.5), alpha: float = 1.5, **settings) -> list[dict]:
    """A stand-in for an unseen country: stackers fitted on one country's fold 0 score another's, for each set of
    features left out, with that country's scores shifted."""
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    dim = everyone.where(fold(F.col("s1_id"), 5) == 0).join(_of_country(spark, cfg), "s1_id").where(F.col("country").isin(seen, unseen))
    home, away = folds.leave_out(dim, unseen)
    table, columns = stacker_table(spark, cfg, _within(pairs, dim), pairs.drop("label"), "train", scores, missing="lgbm", meta=True)
    out = []
    for drop in drops:
        left = [c for c in columns if not any(c in features.GROUPS[g] or c in ("b_source",) * (g == "meta") for g in drop)]
        model = learn.fit_and_refit(_within(table, home), left, **settings)
        scored = learn.predict(model, _within(table, away), left).select(*KEYS, "prob")
        for d in shifts:
            moved = scored.withColumn("prob", blends.shifted(F.col("prob"), d))
            out.append({"drop": list(drop), "features": len(left), "shift": d, "macro_f05": _macro(moved, gold, away, decide.Params("expf", alpha=alpha))})
    return out


# --- reports


def eda(spark: SparkSession, cfg: Config, split: str = "train") -> dict:
    """Profile of the sources; with gold, how many matches records have, pool records matched twice, shared countries."""
    s1, pool = tables.load_sources(spark, cfg.data_dir, split)
    out = {"profile": [r.asDict() for r in reports.profile(s1.unionByName(pool)).orderBy("source", "country").collect()]}
    if split == "train":
        gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
        out["matches"] = {r["n_match"]: r["n_s1"] for r in reports.match_counts(gold, everyone).collect()}
        out["distinct"] = reports.distinct_counts(s1.unionByName(pool), ["entity_id", "business_name", "country"]).first().asDict()
        out["violations"] = reports.one_to_one_violations(gold).first()["violations"]
        out |= reports.same_country(gold, s1.select(F.col("entity_id").alias("s1_id"), "country"), pool.select(F.col("entity_id").alias("pool_id"), "country")).first().asDict()
    return out


def blocking_eval(spark: SparkSession, cfg: Config, caps=(20, 25, 30, 40, 60, 80)) -> dict:
    """Recall of each pass and of the union at several depths, and recall and size of the union at several caps."""
    cands = spark.read.parquet(cfg.at("train", "cands.parquet"))
    gold, _ = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    ranks = [c for c in ("tok_rank", "emb_rank", "best_rank") if c in cands.columns]
    out = {c: {r["k"]: r["recall"] for r in metrics.recall_at(cands, c, gold).collect()} for c in ranks}
    passes = [cands.where(F.col(c) < blocking.ABSENT).select(*KEYS, c, c.replace("rank", "score")) for c in ranks[:-1]]
    out["caps"] = {}
    for cap in caps:
        capped = blocking.union_passes(*passes, cap=cap)
        out["caps"][cap] = {"recall": metrics.blocking_recall(capped, gold).first()["recall"], "pairs": capped.count()}
    return out


def decision_eval(spark: SparkSession, cfg: Config, pairs: DataFrame, shift_country: str | None = None) -> dict:
    """The approximate and the exact rule compared, taking in records without an address, shifts of a country."""
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    dim = everyone.join(_of_country(spark, cfg), "s1_id")
    _, pool = tables.load_normalized(spark, cfg.at("train", ""), ["entity_id", "addr_clean"])
    empty = pool.where("addr_clean = ''").select(F.col("entity_id").alias("pool_id"), F.lit(True).alias("empty_addr"))
    marked = pairs.join(empty, "pool_id", "left").fillna(False, ["empty_addr"])
    out = {"rules": {r["rule"]: r["macro_f05"] for r in reports.rules_compared(pairs, gold, dim).collect()}}
    out["assigned"] = {r["t"]: r["macro_f05"] for r in reports.assignment_sweep(marked, decide.decide(pairs, USUAL), gold, dim).collect()}
    if shift_country:
        out["shifted"] = {r["shift"]: r["macro_f05"] for r in reports.shift_sweep(pairs, gold, dim, shift_country).collect()}
    return out


def error_analysis(spark: SparkSession, cfg: Config, pairs: DataFrame, examples: int = 8) -> dict:
    """Where score is lost, counts of pairs right and wrong, and records of each kind of error with their texts."""
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    dim = everyone.join(_of_country(spark, cfg), "s1_id")
    kinds = metrics.loss_kinds(decide.decide(pairs, USUAL), gold, dim, pairs)
    losses = [r.asDict() for r in metrics.loss_decomposition(kinds).orderBy(F.desc("loss")).collect()]
    s1 = spark.read.parquet(cfg.at("train", "s1.parquet")).select(F.col("entity_id").alias("s1_id"), "business_name", "business_address")
    shown = [reports.error_examples(kinds, k, examples).join(s1, "s1_id") for k in sorted({r["kind"] for r in losses})]
    return {"losses": losses, "pairs": metrics.error_accounting(kinds).first().asDict(), "examples": [r.asDict() for r in reduce(DataFrame.unionByName, shown).collect()] if shown else []}


def package(files: dict[str, str], path: str) -> int:
    """A ZIP file of local files by their names in it; nothing is written if one of them is missing."""
    missing = [f for f in files.values() if not os.path.exists(f)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(sorted(missing))}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as out:
        for name, source in files.items():
            parts = sorted(glob.glob(f"{source}/part-*")) if os.path.isdir(source) else [source]
            with out.open(name, "w") as member:
                for k, part in enumerate(parts):
                    with open(part, "rb") as file:
                        if k:  # parts of a table have a header each
                            file.readline()
                        shutil.copyfileobj(file, member)
    return len(files)


# --- the command line


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> None:
        one = sub.add_parser(name)
        one.add_argument("--config")
        for option, spec in options.items():
            one.add_argument(f"--{option.replace('_', '-')}", **spec)

    many, needed, number, flag = {"action": "append", "default": []}, {"required": True}, {"type": float}, {"action": "store_true"}
    command("validate", matching=needed, candidate={}, test_dir=needed, check_ids=flag)
    command("experiment", tag=needed, mode={"choices": ["fold0", "loco"], "default": "fold0"}, drop={"default": ""}, settings={"default": "{}"})
    command("ablation", group={"default": "decoy"}, settings={"default": "{}"})
    command("feature-sets", home=needed, away=needed, settings={"default": "{}"})
    command("learning-curve", settings={"default": "{}"})
    command("ce-average", member=many, kind=needed, out=needed)
    command("blend-eval", pairs=needed, ce=needed)
    command("blend-submit", pairs=needed, ce=needed, blend={"choices": ["prob", "logit", "ce"], "required": True}, w={**number, "default": 1.0}, params={"required": True}, out=needed, shift={"default": ""})
    command("stack-eval", pairs=needed, ce=needed, extra=many, set=many, settings={"default": "{}"})
    command(
        "stack-submit", pairs=needed, lgbm_test=needed, ce=needed, extra=many, out=needed, alpha={**number, "default": 1.5}, features={"choices": ["pool", "meta"], "default": "pool"}, raw=flag, fill=many,
        ce_fill={"choices": ["zero", "lgbm"], "default": "zero"}, swap={"default": ""}, unseen_prob={"default": ""}, unseen_mix={"default": ""}, shift={"default": ""}, s1_from={"default": ""}, settings={"default": "{}"},
    )
    command("proxy-eval", pairs=needed, ce=needed, extra=many, seen=needed, unseen=needed, settings={"default": "{}"})
    command("package", team=needed, answer=needed, out_dir={"default": "."}, file=many)
    command("eda", split={"default": "train"})
    command("blocking-eval")
    command("decision-eval", pairs=needed, shift_country={})
    command("errors", pairs=needed)
    command("diff", a=needed, b=needed)
    args = ap.parse_args(argv)
    spark, cfg = SparkSession.builder.appName("matchloom").getOrCreate(), Config.read(args.config)
    settings = json.loads(getattr(args, "settings", "{}"))
    drop = tuple(x for x in getattr(args, "drop", "").split(",") if x)
    probs = lambda at: tables.read_pairs(spark, at).withColumnRenamed("lgbm_prob", "prob")
    extra = dict(x.split("=") for x in getattr(args, "extra", []))
    scores = lambda kind: {"ce": _scores(spark, args.ce, kind)} | {n: _scores(spark, d, kind, f"{n}_prob") for n, d in extra.items()}
    if args.command == "validate":
        errors, warnings = check_answer(spark, args.matching, args.test_dir, args.candidate, args.check_ids)
        for text in [*(f"warning: {w}" for w in warnings), *errors, "broken" if errors else "sound"]:
            print(text)
        return int(bool(errors))
    if args.command == "experiment":
        print((experiment if args.mode == "fold0" else left_out_country)(spark, cfg, args.tag, drop, **settings))
    elif args.command == "ablation":
        print(ablation(spark, cfg, args.group, **settings))
    elif args.command == "feature-sets":
        print(feature_sets(spark, cfg, args.home, args.away, **settings))
    elif args.command == "learning-curve":
        print(learning_curve(spark, cfg, **settings))
    elif args.command == "ce-average":
        sinks.write_stage(blends.average([_scores(spark, d, args.kind) for d in args.member]), f"{args.out}/ce_{args.kind}_part0.parquet")
    elif args.command == "blend-eval":
        print(blend_eval(spark, cfg, probs(args.pairs), _scores(spark, args.ce, "oof_fold0")))
    elif args.command == "blend-submit":
        params = decide.Params(**json.loads(args.params))
        print(blend_submit(spark, cfg, probs(args.pairs), _scores(spark, args.ce, "test"), args.blend, args.w, params, args.out, args.shift))
    elif args.command == "stack-eval":
        print(stack_eval(spark, cfg, tables.read_pairs(spark, args.pairs), scores("oof_fold0"), tuple(args.set or ("pool", "meta")), **settings))
    elif args.command == "stack-submit":
        swap = args.swap.split("=") if args.swap else None
        given = dict(
            alpha=args.alpha, meta=args.features == "meta", raw=args.raw, fill=args.fill, missing=args.ce_fill, shift=args.shift, unseen_mix=args.unseen_mix,
            swap=(swap[0], _scores(spark, swap[1], "test_unseen", f"{swap[0]}_prob")) if swap else None,
            unseen_prob=spark.read.parquet(args.unseen_prob) if args.unseen_prob else None, s1_from=spark.read.parquet(args.s1_from).select("s1_id") if args.s1_from else None,
        )
        print(stack_submit(spark, cfg, tables.read_pairs(spark, args.pairs), tables.read_pairs(spark, args.lgbm_test).drop("label"), scores("oof_fold0"), scores("test"), args.out, **given, **settings))
    elif args.command == "proxy-eval":
        print(proxy_eval(spark, cfg, tables.read_pairs(spark, args.pairs), scores("oof_fold0"), args.seen, args.unseen, **settings))
    elif args.command == "package":
        answers = {f"output/{n}": f"{args.answer}/{n}" for n in ("matching_results.tsv", "candidate_pairs.tsv")}
        print(package(answers | {os.path.basename(f): f for f in args.file}, f"{args.out_dir}/{args.team}_submission.zip"))
    elif args.command == "eda":
        print(eda(spark, cfg, args.split))
    elif args.command == "blocking-eval":
        print(blocking_eval(spark, cfg))
    elif args.command == "decision-eval":
        print(decision_eval(spark, cfg, probs(args.pairs), args.shift_country))
    elif args.command == "errors":
        print(error_analysis(spark, cfg, probs(args.pairs)))
    elif args.command == "diff":
        gold = lambda at: tables.load_gold(spark, at)[0]
        metrics.submission_diff(gold(args.a), gold(args.b), _of_country(spark, cfg, "test")).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
