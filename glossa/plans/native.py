"""Token patterns as regular expressions of the JVM.

A token becomes one character that says which of a pattern's constraints it meets, a sentence a string of them, and the pattern a regular expression
over these characters, so that the JVM finds its matches.

Taken are constraints on the layers of tokens, sequences, alternatives, repetitions, anchors and look-around. Numbers, repetitions without
an end of more than one token (whose matching would recurse for each token), and look-behind without an end are left to the kernel, which gives the same results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import FIELDS, Parser, unquote

_ASCII = "0123456789abcdefghijklmnopqrstuv"
Get = Callable[[str], Column]


class NotNative(ValueError):
    """The pattern needs the kernel."""


def _text_test(kind: str, text: str) -> Callable[[Column], Column]:
    if kind != "regex":
        want = unquote(text) if kind == "string" else text
        return lambda c: c == F.lit(want)
    body = text[1:-1].replace(r"\/", "/")
    if "(?P" in body or re.search(r"\\[AZzbB]|\(\?[aLux]", body):
        raise NotNative("a regex that Java reads otherwise")
    return lambda c: c.rlike("(?U)" + body)


class NativeParser(Parser):
    """The parser of token patterns, whose tests are functions from a token's fields to a column; `tests` are those met."""

    def __init__(self, text: str, unit: str = "word"):
        super().__init__(text, unit)
        self.tests: list[Callable[[Get], Column]] = []
        self.fields: set[str] = set()

    def constraint(self):
        self.take("[")
        test = (lambda get: F.lit(True)) if self.peek()[1] == "]" else self.disjunction()
        self.take("]")
        return self._numbered(test)

    def _numbered(self, test) -> int:
        self.tests.append(test)
        return len(self.tests) - 1

    def disjunction(self):
        tests = [self.conjunction()]
        while self.accept("|"):
            tests.append(self.conjunction())
        return lambda get: _folded(tests, get, lambda a, b: a | b)

    def conjunction(self):
        tests = [self.negation()]
        while self.accept("&"):
            tests.append(self.negation())
        return lambda get: _folded(tests, get, lambda a, b: a & b)

    def negation(self):
        if self.accept("!"):
            test = self.negation()
            return lambda get: ~test(get)
        return super().negation()

    def comparison(self):
        raise NotNative("numbers")

    def unit_test(self, kind: str, text: str):
        if kind not in ("string", "regex", "name", "number"):
            raise NotNative("not a test of a token's field")
        return self._test(self.unit, kind, text)

    def field(self, name: str):
        kind, text = self.take()
        if name not in FIELDS:
            raise NotNative(f"field {name}")
        return self._test(name, kind, text)

    def _test(self, name: str, kind: str, text: str):
        test = _text_test(kind, text)
        self.fields.add(name)
        return lambda get: F.coalesce(test(get(name)), F.lit(False))

    def single(self):
        node = super().single()
        return ("tok", self._numbered(node[1])) if node[0] == "tok" and not isinstance(node[1], int) else node


def _folded(tests: list, get: Get, join) -> Column:
    out = tests[0](get)
    for t in tests[1:]:
        out = join(out, t(get))
    return out


def _chars(n: int) -> str:
    return _ASCII[: 1 << n] if 1 << n <= len(_ASCII) else "".join(chr(0x4E00 + i) for i in range(1 << n))


def _regex(node: tuple, chars: str, behind: bool = False) -> str:
    match node:
        case ("seq", parts):
            return "".join(_regex(p, chars, behind) for p in parts)
        case ("alt", parts):
            return f"(?:{'|'.join(_regex(p, chars, behind) for p in parts)})"
        case ("tok", i):
            return f"[{''.join(c for m, c in enumerate(chars) if m >> i & 1)}]"
        case ("rep", inner, low, high, greedy):
            if high is None and (behind or inner[0] != "tok") and not (inner[0] == "seq" and len(inner[1]) == 1 and inner[1][0][0] == "tok" and not behind):
                raise NotNative("a repetition without an end")
            times = f"{{{low},{'' if high is None else high}}}"
            return f"(?:{_regex(inner, chars, behind)}){times}{'' if greedy else '?'}" if inner[0] != "tok" else f"{_regex(inner, chars, behind)}{times}{'' if greedy else '?'}"
        case ("look", inner, ahead, negative):
            return f"(?{'' if ahead else '<'}{'!' if negative else '='}{_regex(inner, chars, behind or not ahead)})"
        case ("edge", mark):
            return r"\A" if mark == "^" else r"\z"
    raise NotNative(node[0])
