"""Stages of a linkage run: normalize, embed, block, features, rank, decide. Each leaves a table for the next.

python -m matchloom.plans.pipeline --stage all --split train --config config.json [--resume] [--embedder module:function]
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, record_text
from ..operators import blocking, context, decide, features, folds, learn, metrics, validate
from ..sources import sinks, tables

#: The order of a file's lines, as columns: where a piece of the file begins, and the line's number in it.
LINE = ("file_at", "line_at")
STAGES = ("normalize", "embed", "block", "features", "rank", "decide")


@dataclass(frozen=True)
class Config:
    data_dir: str = "dataset"
    work_dir: str = "artefacts"
    out_dir: str = "output"
    model: str = "default"
    seed: int = 42
    folds: int = 5
    token_top_k: int = 12
    token_max_df: int = 3000
    embed_top_k: int = 20
    cap: int = 25
    sample_s1: int = 200_000
    tune_max_s1: int = 300_000
    learner: dict = field(default_factory=dict)
    resume: bool = False

    @classmethod
    def read(cls, path: str | None) -> Config:
        given = tables.read_config(path) if path else {}
        return cls(**{k: v for k, v in given.items() if k in {f.name for f in fields(cls)}})

    def at(self, split: str, name: str) -> str:
        return f"{self.work_dir}/{split}/{name}"


def _ready(spark: SparkSession, cfg: Config, path: str) -> bool:
    """Whether a resumed run has this table already: whole ones only, which end in a mark of success."""
    return cfg.resume and tables._exists(spark, f"{path}/_SUCCESS")


def stage_normalize(spark: SparkSession, cfg: Config, split: str) -> None:
    for k in (1, 2, 3):
        if _ready(spark, cfg, at := cfg.at(split, f"s{k}.parquet")):
            continue
        raw = tables.read_tsv(spark, f"{cfg.data_dir}/{split}/{split}_source{k}.tsv", tables.RECORD, lines=True)
        sinks.write_stage(normalize(raw.withColumn("source", F.lit(k).cast("byte"))), at)


def embedder(name: str | None) -> Callable | None:
    """The function behind module:function, or none."""
    if not name:
        return None
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def stage_embed(spark: SparkSession, cfg: Config, split: str, embed: Callable | None = None) -> None:
    """embed: a function of a string column that gives an array of floats of norm 1; without it the stage does nothing.
    Tables that are there already are kept."""
    if embed is None:
        return
    for k in (1, 2, 3):
        at = cfg.at(split, f"emb{k}.parquet")
        if tables._exists(spark, f"{at}/_SUCCESS"):
            continue
        records = spark.read.parquet(cfg.at(split, f"s{k}.parquet"))
        text = record_text(F.col("name_clean"), F.col("addr_clean"))
        sinks.write_stage(records.select("entity_id", embed(text).alias("embedding")), at)


def _with_vectors(spark: SparkSession, cfg: Config, split: str) -> tuple[DataFrame, DataFrame]:
    from ..functions.text import token_docs

    out = []
    for sources, name in (((1,), "s1_id"), ((2, 3), "pool_id")):
        parts = []
        for k in sources:
            r = spark.read.parquet(cfg.at(split, f"s{k}.parquet"))
            r = r.select("entity_id", F.col("country_norm").alias("country"), token_docs(r).alias("tokens"))
            if tables._exists(spark, cfg.at(split, f"emb{k}.parquet")):
                r = r.join(spark.read.parquet(cfg.at(split, f"emb{k}.parquet")), "entity_id")
            parts.append(r.withColumnRenamed("entity_id", name))
        out.append(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    return out[0], out[1]


def stage_block(spark: SparkSession, cfg: Config, split: str) -> dict:
    """Candidates of all records; in training also the recall of each pass and of their union, and the best score that
    a matcher could reach with these candidates, over the sampled records."""
    at = cfg.at(split, "cands.parquet")
    if not _ready(spark, cfg, at):
        s1, pool = _with_vectors(spark, cfg, split)
        sinks.write_stage(blocking.block_all(s1, pool, cfg.token_top_k, cfg.token_max_df, cfg.embed_top_k, cfg.cap), at, by="s1_id")
    if split != "train":
        return {}
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    ids = folds.sample(everyone, cfg.sample_s1, seed=cfg.seed)
    done, gold = spark.read.parquet(at).join(ids, "s1_id", "left_semi"), gold.join(ids, "s1_id", "left_semi")
    passes = {c[:3]: done.where(F.col(c) < blocking.ABSENT) for c in ("tok_rank", "emb_rank") if c in done.columns}
    found = {f"recall_{name}": metrics.blocking_recall(rows, gold).first()["recall"] for name, rows in (passes | {"union": done}).items()}
    return found | {"oracle_f05": metrics.oracle_f05(done, gold, ids).first()["oracle_f05"]}


def stage_features(spark: SparkSession, cfg: Config, split: str) -> None:
    """Rivalry over all pairs first, then, in training, a sample of primary records, then their features."""
    if _ready(spark, cfg, at := cfg.at(split, "feats.parquet")):
        return
    s1, pool = tables.load_normalized(spark, cfg.at(split, ""))
    cands = context.global_context(spark.read.parquet(cfg.at(split, "cands.parquet")))
    if split == "train":
        picked = folds.sample(s1.select(F.col("entity_id").alias("s1_id")), cfg.sample_s1, seed=cfg.seed)
        cands = cands.join(picked, "s1_id", "left_semi")
    sinks.write_stage(features.pair_features(cands, s1, pool), at, by="s1_id")


ID_COLUMNS = ("s1_id", "pool_id")


def _features(spark: SparkSession, cfg: Config, split: str) -> tuple[DataFrame, list[str]]:
    feats = spark.read.parquet(cfg.at(split, "feats.parquet"))
    return feats, [c for c in feats.columns if c not in ID_COLUMNS]


def labelled_features(spark: SparkSession, cfg: Config) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """Training features with their label, the features' names, gold pairs, and the ids of the sampled records."""
    feats, columns = _features(spark, cfg, "train")
    gold, everyone = tables.load_gold(spark, f"{cfg.data_dir}/train/train_ground_truth.tsv")
    s1, pool = tables.load_normalized(spark, cfg.at("train", ""), ["entity_id"])
    gold = tables.resolved(gold, s1, pool)
    ids = folds.sample(everyone, cfg.sample_s1, seed=cfg.seed)
    marked = feats.join(gold.select(*ID_COLUMNS, F.lit(1).alias("label")), list(ID_COLUMNS), "left").fillna(0, ["label"])
    return marked, columns, gold.join(ids, "s1_id", "left_semi"), ids


def _tuned(spark: SparkSession, cfg: Config, table: str, gold: DataFrame, ids: DataFrame):
    ids = folds.sample(ids, cfg.tune_max_s1, seed=cfg.seed)
    pairs = spark.read.parquet(table).join(ids, "s1_id", "left_semi")
    return decide.best_setting(decide.tune(pairs, gold.join(ids, "s1_id", "left_semi"), ids)).first()


def stage_rank(spark: SparkSession, cfg: Config, split: str) -> dict:
    """train: out-of-fold scores, models and the decision; a second stage over the first's scores, kept if it gains
    enough. test: the mean of the fold models, of the second stage where there is one."""
    home = f"{cfg.work_dir}/models_{cfg.model}"
    if split != "train":
        feats, columns = _features(spark, cfg, split)
        decision = spark.read.parquet(f"{home}/decision").first()
        done = learn.predict_mean(learn.load(home, cfg.folds), feats, columns)
        if decision["stage"] == 2:
            sinks.write_stage(done, cfg.at(split, "first.parquet"), by="s1_id")
            done, more = learn.second_stage(spark.read.parquet(cfg.at(split, "first.parquet")))
            done = learn.predict_mean(learn.load(home, cfg.folds, 2), done.drop("prob"), columns + more)
        sinks.write_stage(done.select(*ID_COLUMNS, "prob"), cfg.at(split, f"probs_{cfg.model}.parquet"))
        return {"stage": decision["stage"]}
    labelled, columns, gold, ids = labelled_features(spark, cfg)
    oof, models = learn.out_of_fold(labelled, columns, cfg.folds, **cfg.learner)
    learn.save(models, home)
    first_at, second_at = cfg.at(split, "oof.parquet"), cfg.at(split, "oof2.parquet")
    sinks.write_stage(oof, first_at, by="s1_id")
    first = _tuned(spark, cfg, first_at, gold, ids)
    context_, more = learn.second_stage(spark.read.parquet(first_at))
    oof2, models2 = learn.out_of_fold(context_.drop("prob"), columns + more, cfg.folds, **cfg.learner)
    sinks.write_stage(oof2.select(*ID_COLUMNS, "prob"), second_at)
    second = _tuned(spark, cfg, second_at, gold, ids)
    stage, best = (2, second) if learn.accepted(first["macro_f05"], second["macro_f05"]) else (1, first)
    if stage == 2:
        learn.save(models2, home, 2)
    row = {"stage": stage} | {k: best[k] for k in ("method", "t", "r", "alpha", "one_to_one", "macro_f05")}
    schema = "stage int, method string, t double, r double, alpha double, one_to_one boolean, macro_f05 double"
    spark.createDataFrame([tuple(row.values())], schema).write.mode("overwrite").parquet(f"{home}/decision")
    return row | {"first": first["macro_f05"], "second": second["macro_f05"], "top_features": learn.importance(models, columns)}


def records(spark: SparkSession, cfg: Config, split: str = "test") -> DataFrame:
    """s1_id, country and place in the file of the primary records."""
    s1 = spark.read.parquet(cfg.at(split, "s1.parquet"))
    return s1.select(F.col("entity_id").alias("s1_id"), F.col("country_norm").alias("country"), *LINE)


def answer(spark: SparkSession, cfg: Config, pairs: DataFrame, params: decide.Params, directory: str, extra: DataFrame | None = None) -> dict:
    """Decides scored test pairs, writes the answer in the order of the records' file and checks it."""
    s1, cands = records(spark, cfg), spark.read.parquet(cfg.at("test", "cands.parquet"))
    told = sinks.write_answer(decide.decide(pairs, params), cands, s1, directory, extra, LINE)
    errors, warnings = validate.validate(spark, f"{directory}/matching_results.tsv", s1.select("s1_id"), f"{directory}/candidate_pairs.tsv")
    return told | {"errors": errors, "warnings": warnings}


def stage_decide(spark: SparkSession, cfg: Config, split: str) -> dict:
    """The answer for the test split; decisions on the training split are tuned and scored by rank."""
    if split != "test":
        return {}
    b = spark.read.parquet(f"{cfg.work_dir}/models_{cfg.model}/decision").first()
    params = decide.Params(b["method"], b["t"] or 0.0, b["r"] or 0.0, b["alpha"] or 0.0, b["one_to_one"])
    return answer(spark, cfg, spark.read.parquet(cfg.at(split, f"probs_{cfg.model}.parquet")), params, f"{cfg.out_dir}/{split}")


def run(spark: SparkSession, cfg: Config, split: str, stages=STAGES, embed: Callable | None = None) -> dict[str, dict]:
    """The stages in order, and what each reports."""
    do = {"normalize": stage_normalize, "block": stage_block, "features": stage_features, "rank": stage_rank, "decide": stage_decide}
    do["embed"] = lambda spark, cfg, split: stage_embed(spark, cfg, split, embed)
    return {name: do[name](spark, cfg, split) or {} for name in stages}


def main(argv: list[str] | None = None) -> int:
    """Returns 1 if the answer that was written breaks a rule of its format, else 0."""
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--stage", choices=["all", *STAGES], default="all")
    ap.add_argument("--split", choices=["train", "test"], default="train")
    ap.add_argument("--config")
    ap.add_argument("--resume", action="store_true", help="keep tables that an earlier run has finished")
    ap.add_argument("--embedder", help="module:function of a string column that gives unit vectors")
    args = ap.parse_args(argv)
    cfg, spark = replace(Config.read(args.config), resume=args.resume), SparkSession.builder.appName("matchloom").getOrCreate()
    told = run(spark, cfg, args.split, STAGES if args.stage == "all" else (args.stage,), embedder(args.embedder))
    for name, values in told.items():
        print(name, values)
    return int(bool(told.get("decide", {}).get("errors")))


if __name__ == "__main__":
    raise SystemExit(main())
