"""Checks of an answer file against the rules of its format, as a table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHING, CANDIDATES = ["source1_entity_id", "matched_entity_ids"], ["source1_entity_id", "candidate_entity_ids"]
SHOWN = 5


def examples(n: int, shown: str) -> str:
    """What is shown of n items, the first SHOWN in order, and how many there are if these are not all."""
    return f"{n} total, e.g. {shown}, ..." if n > SHOWN else shown


def header_fault(line: str | None, expected: list[str]) -> str | None:
    """What is wrong with a first line, if anything: then no row is looked at."""
    if line is None or not line.strip():
        return "empty"
    if "\t" not in line and "," in line:
        return "comma_separated"
    return None if [c.strip().lower() for c in line.rstrip("\n").split("\t")] == expected else "wrong_header"


def findings(lists: DataFrame, required: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """kind, n, examples of the faults of a list table (s1_id, ids: array, in file order).

    required: s1_id of all records that need a row; targets: pool_id of the known records, if they are to be checked.
    """
    each = lists.select("s1_id", F.explode(F.array_distinct("ids")).alias("pool_id"))
    own = F.startswith("pool_id", F.lit("S1-"))
    known = F.startswith("pool_id", F.lit("S2-")) | F.startswith("pool_id", F.lit("S3-"))
    found = {
        "duplicate_row": lists.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("s1_id").alias("x")),
        "repeated_id": lists.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("x")),
        "self_match": each.where(own).select(F.col("pool_id").alias("x")),
        "wrong_prefix": each.where(~own & ~known).select(F.col("pool_id").alias("x")),
        "missing": required.select("s1_id").join(lists, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
        "extra": lists.join(required, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
    }
    if targets is not None:
        found["unknown_id"] = each.where(known).join(targets.select("pool_id"), "pool_id", "left_anti").select(F.col("pool_id").alias("x"))
    rows = reduce(DataFrame.union, [df.select(F.lit(k).alias("kind"), F.col("x").cast("string").alias("x")) for k, df in found.items()]).distinct()
    # Only the first few of each kind are carried: ranks are cut before anything is gathered.
    from pyspark.sql import Window as W

    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("kind").orderBy("x"))).where(F.col("_r") <= SHOWN)
    shown = first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
    return rows.groupBy("kind").agg(F.count("*").alias("n")).join(shown, "kind")


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates: a warning, not a fault."""
    return matches.select("s1_id", "pool_id").join(candidates.select("s1_id", "pool_id"), ["s1_id", "pool_id"], "left_anti")


def read_lists(spark: SparkSession, path: str, expected: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The lists of a file, and fatal faults of its header or rows without a tab."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    first = lines.limit(1).first()
    fault = header_fault(first["line"] if first else None, expected)
    if fault:
        return None, [fault]
    body = lines.where(F.lower(F.trim(F.col("line"))) != first["line"].strip().lower())
    bad = body.where((F.instr("line", "\t") == 0) & (F.trim("line") != ""))
    n = bad.count()
    rest = F.substring_index("line", "\t", -1)
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(line, instr(line, '\t') + 1)"), ","))
    lists = body.where(F.instr("line", "\t") > 0).select(F.substring_index("line", "\t", 1).alias("s1_id"), ids.alias("ids"))
    return lists, [f"malformed_row: {n}"] if n else []


def validate(spark: SparkSession, matching: str, required: DataFrame, candidate: str | None = None, targets: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of an answer file and, if given, its candidate file."""
    errors: list[str] = []
    warnings: list[str] = []
    tables = {}
    for name, path, expected in (("matching", matching, MATCHING), ("candidates", candidate, CANDIDATES)):
        if path is None:
            continue
        try:
            lists, faults = read_lists(spark, path, expected)
        except Exception as error:  # a file that cannot be read is a finding
            if "PATH_NOT_FOUND" not in str(error):
                raise
            lists, faults = None, ["missing_file"]
        errors += [f"{name}: {f}" for f in faults]
        if lists is not None:
            tables[name] = lists.select("s1_id", F.explode("ids").alias("pool_id"))
            errors += [f"{name}: {r['kind']} ({r['n']}): {examples(r['n'], r['examples'])}" for r in findings(lists, required, targets).orderBy("kind").collect()]
    if len(tables) == 2:
        outside = outside_candidates(tables["matching"], tables["candidates"]).select("s1_id").distinct()
        n, first = outside.count(), ", ".join(r["s1_id"] for r in outside.orderBy("s1_id").limit(SHOWN).collect())
        warnings += [f"{n} records have matches that are not among their candidates: {examples(n, first)}"] if n else []
    return errors, warnings
