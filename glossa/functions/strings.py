"""Edit distance with its operations, and Porter's stemmer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def edits(a: str, b: str, transpose: bool = False, capital: bool = False) -> tuple[float, list[tuple[str, str, str]]]:
    """(distance, script): least cost of insertions, deletions and substitutions, and of transpositions if asked for;
    a change of capitals is free if asked for. The script lists (operation, from, to)."""
    n, m = len(a), len(b)
    cost = [[float(i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    step = [["insert" if not i else "delete" for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            options = [(cost[i - 1][j - 1] + (x != y), "keep" if x == y else "substitute"), (cost[i - 1][j] + 1, "delete"), (cost[i][j - 1] + 1, "insert")]
            if capital and x != y and x.lower() == y.lower():
                options.append((cost[i - 1][j - 1], "capital"))
            if transpose and i > 1 and j > 1 and x != y and (x, a[i - 2]) == (b[j - 2], y):
                options.append((cost[i - 2][j - 2] + 1, "transpose"))
            cost[i][j], step[i][j] = min(options, key=lambda o: o[0])
    script, i, j = [], n, m
    while i or j:
        op = step[i][j]
        di, dj = {"insert": (0, 1), "delete": (1, 0), "transpose": (2, 2)}.get(op, (1, 1))
        script.append((op, a[i - di : i], b[j - dj : j]))
        i, j = i - di, j - dj
    return cost[n][m], script[::-1]


def _form(stem: str) -> str:
    """C and V for each letter of a stem."""
    out = ""
    for i, c in enumerate(stem):
        out += "V" if c in "aeiou" or (c == "y" and i and out[-1] == "C") else "C"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("V+C+", _form(stem)))


def _short(stem: str) -> bool:
    return _form(stem).endswith("CVC") and stem[-1] not in "wxy"


# The suffixes of Porter's second to fourth steps.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of an English word."""
    w = word.lower()
    if len(w) <= 2:
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "V" in _form(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "C" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "V" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table, key=lambda p: -len(p)):
            suffix, _, new = pair.partition(":")
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted([*_STEP4, "ion"], key=lambda s: -len(s)):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of a column; each distinct word is stemmed once a batch."""
    for s in words:
        known = {w: porter(w) for w in s.dropna().unique()}
        yield pd.Series([known.get(w) for w in s], dtype=object)


def day_replaced(date: Column, day: Column) -> Column:
    """A date whose last part is the number, in two digits."""
    return F.concat(F.regexp_extract(date, "^(.*-)?", 0), F.lpad(day.cast("string"), 2, "0"))


def last_weeks(year: Column, month: Column, n: int) -> Column:
    """The range of the last 1, 2 or 3 weeks of a month, counted back from the length it has in a year of 365 days."""
    length = F.when(month == 2, 28).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    head = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(head, two(length - (7 * n - 1)), F.lit(" -- "), head, two(length))
