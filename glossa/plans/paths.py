"""Graph patterns: `role:Label? = nsubj [tag=NN] | >dobj /prep/*`, over the edges of a sentence.

A path takes tokens to tokens along edges: names or regexes forward, `<name` backward, `>>` and `<<` along any edge, concatenation,
`|`, grouping, `? * + {n} {n,m}`, token constraints and look-around. Tokens reached twice keep the path found first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .patterns import Parser, PatternError, Program, compile_pattern, string_test

Step = Callable[[object, int], list[tuple[int, tuple]]]


def _first(found: list[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
    return list({t: (t, p) for t, p in reversed(found)}.values())[::-1]


def _then(left: Step, right: Step) -> Step:
    return lambda s, t: _first([(b, p + q) for a, p in left(s, t) for b, q in right(s, a)])


def _closure(step: Step, low: int) -> Step:
    def run(s, t):
        out = [(t, ())] if not low else []
        seen, front = ({t} if not low else set()), [(t, ())]
        while front:
            ahead = []
            for a, p in front:
                for b, q in step(s, a):
                    if b not in seen:
                        seen.add(b)
                        out.append((b, p + q))
                        ahead.append((b, p + q))
            front = ahead
        return out

    return run


class PathParser(Parser):
    def path(self) -> Step:
        step = self.either()
        if self.peek()[0] != "end":
            raise PatternError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return step

    def either(self) -> Step:
        steps = [self.chain()]
        while self.accept("|"):
            steps.append(self.chain())
        return steps[0] if len(steps) == 1 else lambda s, t: _first([x for f in steps for x in f(s, t)])

    def chain(self) -> Step:
        step = None
        while self.peek()[0] != "end" and not (self.peek()[0] == "op" and self.peek()[1] in ("|", ")")):
            here = self.repeat()
            step = here if step is None else _then(step, here)
        if step is None:
            raise PatternError(f"empty path in {self.text!r}")
        return step

    def repeat(self) -> Step:
        step = self.unit_step()
        while True:
            if op := self.accept("?", "*", "+"):
                inner = step
                step = (lambda f: lambda s, t: _first([(t, ()), *f(s, t)]))(inner) if op == "?" else _closure(inner, int(op == "+"))
            elif self.peek() == ("op", "{"):
                low, high = self.bounds()
                if not low or high is None or high < low:
                    raise PatternError(f"bad repetition in {self.text!r}")
                chains, now = [], None
                for i in range(1, high + 1):
                    now = step if now is None else _then(now, step)
                    if i >= low:
                        chains.append(now)
                step = (lambda fs: lambda s, t: _first([x for f in fs for x in f(s, t)]))(chains)
            else:
                return step

    def unit_step(self) -> Step:
        kind, text = self.peek()
        if kind == "op" and text == "[":
            test = self.constraint()
            return lambda s, t: [(t, ())] if test(s, t) else []
        self.take()
        if kind == "look":
            if "<" in text:
                raise PatternError("look-behind in a path")
            inner, wanted = self.either(), text == "(?="
            self.take(")")
            return lambda s, t: [(t, ())] if bool(inner(s, t)) == wanted else []
        if kind == "op" and text == "(":
            inner = self.either()
            self.take(")")
            return inner
        if kind == "op" and text in (">>", "<<"):
            back = text == "<<"
            return lambda s, t: _first([(o, ((t, o, r),)) for o, r in s.edges(t, back)])
        back = text == "<" and kind == "op"
        if kind == "op" and text in "<>":
            kind, text = self.take()
        if kind not in ("name", "string", "regex"):
            raise PatternError(f"unexpected {text!r} in {self.text!r}")
        test = string_test(kind, text)
        return lambda s, t: _first([(o, ((t, o, r),)) for o, r in s.edges(t, back) if test(r)])


@dataclass
class Argument:
    name: str
    label: str
    low: int  # mentions at least
    high: int | None  # at most; None: no bound
    size: int | None  # mentions of one combination; None: all together
    step: Step


@dataclass
class GraphPattern:
    """trigger: a token pattern, or the label of mentions that serve as trigger or, as `anchor`, as one argument."""

    trigger: Program | None
    trigger_label: str | None
    anchor: tuple[str, str] | None
    arguments: list[Argument]


_HEAD = re.compile(r"^\s*([A-Za-z_][\w-]*)\s*(?::\s*([\w-]+))?\s*(\?|\*|\+|\{\s*\d*\s*,?\s*\d*\s*\})?\s*=\s*", re.M)


def _argument(name: str, label: str, mark: str, path: str, unit: str) -> Argument:
    step = PathParser(path, unit).path()
    low, high, size = {"": (1, None, 1), "?": (0, None, 1), "*": (0, None, None), "+": (1, None, None)}.get(mark, (0, 0, 0))
    if mark.startswith("{"):
        a, comma, b = (x.strip() for x in mark[1:-1].partition(","))
        if not comma:
            low = high = size = int(a)
        else:
            low, high, size = int(a or 0), int(b) if b else None, None
    return Argument(name, label, low, high, size, step)


def compile_graph(text: str, unit: str = "word") -> GraphPattern:
    text = "\n".join(re.sub(r"(?<!\S)#.*$", "", line) for line in text.strip().split("\n"))
    heads = [m for m in _HEAD.finditer(text)]
    if not heads or heads[0].start() > 0:
        raise PatternError(f"no head in {text!r}")
    parts = [(m, text[m.end() : n.start() if n else len(text)].strip()) for m, n in zip(heads, [*heads[1:], None], strict=True)]
    (head, body), rest = parts[0], parts[1:]
    arguments = [_argument(m[1], m[2] or "", (m[3] or "").replace(" ", ""), p, unit) for m, p in rest]
    if any(not a.label for a in arguments):
        raise PatternError(f"an argument without a label in {text!r}")
    if len({a.name for a in arguments}) < len(arguments):
        raise PatternError(f"an argument's name twice in {text!r}")
    if head[1] == "trigger" and not head[2]:
        if re.fullmatch(r"[A-Z][\w-]*", body):
            return GraphPattern(None, body, None, arguments)
        return GraphPattern(compile_pattern(body, unit), None, None, arguments)
    if re.fullmatch(r"[\w-]+", body) and not head[2]:
        return GraphPattern(None, None, (head[1], body), arguments)
    raise PatternError(f"no trigger in {text!r}")
