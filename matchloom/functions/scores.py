"""Arithmetic on probabilities, hashes for folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-6
#: Pairs less likely than this take no part in stacking.
FLOOR = 0.001


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probability_blend(p: Column, q: Column, w: float = 0.5) -> Column:
    return (1 - w) * p + w * q


def logit_blend(p: Column, q: Column, w: float = 0.5) -> Column:
    return sigmoid((1 - w) * logit(p) + w * logit(q))


def mean_logit(*ps: Column) -> Column:
    total = logit(ps[0])
    for p in ps[1:]:
        total = total + logit(p)
    return sigmoid(total / len(ps))


def shifted(p: Column, delta: float) -> Column:
    return sigmoid(logit(p) + delta)


def fold(entity_id: Column, n: int) -> Column:
    """crc32 of the id modulo n: the same fold wherever it is computed."""
    return F.pmod(F.crc32(F.encode(entity_id.cast("string"), "UTF-8")), F.lit(n))


def house_difference(a: Column, b: Column) -> Column:
    """ln(1 + difference) of the first nine digits of two digit strings."""
    number = lambda c: F.substring(c, 1, 9).cast("long")
    return F.log1p(F.abs(number(a) - number(b)))
