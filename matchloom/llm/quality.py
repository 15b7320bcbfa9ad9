"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_list

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on", "as", "by", "this", "are", "was",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par", "sur", "est",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "dem", "nicht", "ein", "eine", "auf", "für",
    "el", "los", "las", "y", "una", "por", "con", "para", "del", "se", "es", "al", "como", "su", "lo",
)

#: The rules: measure, lowest and highest value allowed (None: no bound). Limits that hold bounds themselves pass.
#: Repeated lines: of the labelled documents of sf0.1 that pass the base rule, a limit of 0.30 would reject 10 of 3,243
#: good ones and 1 of 291 bad ones; from 0.35 on it rejects none of either.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.40),
    ("repeat_word_ratio", None, 0.50),
)


def _int_array(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct column `quality` of counts and ratios of each text to docs, and nothing else.

    A null or empty text has no words, counts of 0 and ratios of 0. Lines are split at \\n; a line counts as a
    repeat if it holds a word and equals an earlier line. Words in a three-word window that occurs twice or more in
    the text count as repeated, the first occurrence included.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.withColumn("_w", word_list(t)).withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""))
    w, n = F.col("_w"), F.size("_w")
    # The windows of a text in order of their words, with places; equal windows become neighbours.
    windows = F.sort_array(
        F.transform(
            _int_array(n - 2),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")),
        )
    )
    sorted_ = words.withColumn("_s", windows)
    s, m = F.col("_s"), F.size("_s")
    same = F.zip_with(F.slice(s, 1, F.greatest(m - 1, F.lit(0))), F.slice(s, 2, F.greatest(m - 1, F.lit(0))), lambda x, y: F.when((x["h"] == y["h"]) & (x["k"] == y["k"]), F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)))
    repeated = F.size(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    counted = sorted_.select(
        *docs.columns,
        "_l",
        n.cast("long").alias("_n"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("_c"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("_y"),
        repeated.cast("long").alias("_r"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("_stop"),
    )
    lines = F.size("_l").cast("long")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    dup = lines - F.size(F.array_distinct("_l"))
    out = F.struct(
        F.col("_n").alias("n_words"),
        F.col("_c").alias("word_chars"),
        F.col("_y").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.col("_r").alias("n_repeat_words"),
        lines.alias("n_lines"),
        ratio(F.col("_c"), F.col("_n")).alias("mean_word_chars"),
        ratio(F.col("_y"), F.col("_c")).alias("symbol_ratio"),
        ratio(F.col("_stop"), F.col("_n")).alias("stop_word_ratio"),
        ratio(dup, lines).alias("dup_line_ratio"),
        ratio(F.col("_r"), F.col("_n")).alias("repeat_word_ratio"),
    )
    # Behind a generator: a filter on the measures is not pushed into them, which would compute them once for each use.
    return counted.select(*docs.columns, F.explode(F.array(out)).alias("quality"))


def passes(rules=RULES, column: str = "quality") -> Column:
    """The rule table as one boolean expression over the measures."""
    verdict = F.lit(True)
    for name, low, high in rules:
        value = F.col(f"{column}.{name}")
        if low is not None:
            verdict &= value >= F.lit(low)
        if high is not None:
            verdict &= value <= F.lit(high)
    return verdict


def base_failed(column: str = "quality") -> Column:
    n, r = F.col(f"{column}.n_words"), F.col(f"{column}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept, a row for each row of docs.

    A row with a null id keeps it. An empty table gives no rows. Other columns of docs, whatever their names, are not
    read.
    """
    judged = measures(docs.select(F.col("doc_id"), F.col(text).alias("text")))
    return judged.select("doc_id", "quality.*", base_failed().alias("base_failed"), (~base_failed() & passes(rules)).alias("kept"))
