"""Spans of texts that are to go: how texts are named, how spans of one text are joined and brought back to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """id (doc_id), th (the text's hash) and text of the rows that have both."""
    return docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by spans, in order; runs that touch are one."""
    if not spans:
        return []
    s = np.array(sorted((x["start"], x["end"]) for x in spans), dtype=np.int64)
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return list(zip(s[at, 0].tolist(), reach[np.append(at[1:] - 1, len(s) - 1)].tolist()))


def by_text(spans: DataFrame) -> DataFrame:
    """id, th and spans (array of start and end) from rows id, th, start, end."""
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, text: str) -> DataFrame:
    """docs' columns and, last, the spans, null where a text has none to lose."""
    # The rows travel as one column, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"))
    return rows.join(spans, ["id", "th"], "left").select("row.*", F.col("spans").alias("spans of the text"))


def wider(docs: DataFrame, more: str) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields])
