"""String similarities. Edit distance and set measures are built in; the rest run in Arrow batches."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def letter_bits(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def lcs_with(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence with a string of that size, given by its letters' bits."""
    full = (1 << size) - 1
    row = full
    for c in text:
        if hit := row & masks.get(c, 0):
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time; what both begin or end with is in it."""
    if a == b:
        return len(a)
    if len(a) < len(b):
        a, b = b, a
    head, tail, n = 0, 0, len(b)
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    b = b[head : n - tail]
    return head + tail + (lcs_with(letter_bits(b), len(b), a[head : len(a) - tail]) if b else 0)


def ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); two empty strings are equal."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against the longer's stretches of its length, cut at the ends too.

    The letters that a stretch shares with the shorter string, counted as the stretch moves, bound its ratio: stretches
    are compared from the highest bound down, while one could be better than the best so far.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    m, spare = len(a), Counter(a)  # spare: letters of a that the stretch does not have
    letters, common, bounds = set(a), 0, []
    for end in range(1, len(b) + m):
        low, high = max(0, end - m), min(end, len(b))
        if end <= len(b) and b[end - 1] in letters:
            spare[b[end - 1]] -= 1
            common += spare[b[end - 1]] >= 0
        if end > m and b[low - 1] in letters:
            common -= spare[b[low - 1]] >= 0
            spare[b[low - 1]] += 1
        if b[high - 1] in letters or b[low] in letters:
            bounds.append((2 * common / (m + high - low), low, high))
    best, masks = 0.0, letter_bits(a)
    for bound, low, high in sorted(bounds, reverse=True):
        if bound <= best:
            break
        best = max(best, 2 * lcs_with(masks, m, b[low:high]) / (m + high - low))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens, and those with either side's rest; 0 if a side has no token."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    # What they share is a stretch of either.
    parts = (2 * len(both) / (len(both) + len(x)) if both else 0.0 for x in (one, two))
    return max(ratio(one, two), *parts)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs)) // 2) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


SCORERS = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "jaro_winkler": jaro_winkler}


#: Scores of one kind that a worker remembers.
REMEMBERED = 100_000


@lru_cache(None)
def remembered(name: str):
    return lru_cache(REMEMBERED)(SCORERS[name])


def scorer(name: str):
    """The scorer as a function of two string columns; nulls count as empty."""
    score = SCORERS[name]

    @F.udf("double", useArrow=True)
    def of(a: str | None, b: str | None) -> float:
        return score(a or "", b or "")

    return of


def scores(pairs: list[tuple[Column, Column, str]]) -> Column:
    """Many scores of a row in one pass over Arrow batches: an array of doubles in the order given.

    Records meet many others, and names recur: a worker remembers the scores of strings that it has compared.
    """
    names = [s for _, _, s in pairs]

    @F.udf("array<double>", useArrow=True)
    def of(texts: list[str]) -> list[float]:
        functions = [remembered(n) for n in names]
        return [f(texts[2 * i] or "", texts[2 * i + 1] or "") for i, f in enumerate(functions)]

    return of(F.array(*[c for a, b, _ in pairs for c in (a, b)]))


def jaccard(a: Column, b: Column) -> Column:
    """|A & B| / |A | B|, 0 if a side is empty."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def both_sides(a: Column, b: Column) -> Column:
    return ((F.size(a) > 0) & (F.size(b) > 0)).cast("int")


def conflict(a: Column, b: Column) -> Column:
    """1 if both sets have members and share none."""
    return ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)).cast("int")
