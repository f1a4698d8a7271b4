"""Token patterns: a parser, and a matcher that keeps one thread for each (instruction, token).

Constraints `[lemma=eat & tag=/^V/]`, `[]`, bare strings and regexes on the rule's unit, `|`, grouping, greedy and lazy
`? * + {n,m}`, captures `(?<name> ...)`, `^ $`, look-around in both directions, and mentions `@Label`, `@role:Label.arg`.
Alternatives and repetitions are tried in order of priority, like a backtracking regex, but in time linear in
sentence length times program length, since a place reached before isn't tried again.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

FIELDS = ("word", "lemma", "tag", "entity", "chunk", "norm", "raw")
LAYERS = {"word": "words", "lemma": "lemmas", "tag": "tags", "entity": "entities", "chunk": "chunks", "norm": "norms", "raw": "raw"}
Test = Callable[[object, int], bool]


class PatternError(ValueError):
    pass


_LEX = re.compile(
    r"""\s+|\#[^\n]*|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<regex>/(?:\\.|[^/\\])*/)|(?P<look>\(\?<=|\(\?<!|\(\?=|\(\?!)|(?P<capture>\(\?<[A-Za-z_][\w-]*>)"""
    r"""|(?P<mention>@[\w:.,-]+)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[\w][\w-]*(?::[\w-]+)*)|(?P<op>>>|<<|>=|<=|==|!=|//|\?\?|\*\?|\+\?|[\[\](){}|&!=^$?*+,<>/%:-])""",
    re.X,
)


def lex(text: str) -> list[tuple[str, str]]:
    out, at, inside = [], 0, 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PatternError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup == "regex" and inside and out and (out[-1][0] == "number" or out[-1] == ("op", ")")):
            m = _DIVIDE.match(text, at)  # in a constraint, a slash after a number divides
        kind = m.lastgroup
        if kind:
            out.append((kind, m[0]))
            inside += (out[-1] == ("op", "[")) - (out[-1] == ("op", "]"))
        at = m.end()
    return out


def unquote(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s[1:-1])


def string_test(kind: str, text: str) -> Callable[[str], bool]:
    if kind == "regex":
        found = re.compile(text[1:-1].replace(r"\/", "/")).search
        known: dict = {None: False}  # words come again and again

        def test(s):
            if (hit := known.get(s)) is None:
                if len(known) > 50_000:
                    known.clear()
                    known[None] = False
                hit = known[s] = s is not None and found(s) is not None
            return hit

        return test
    want = unquote(text) if kind == "string" else text
    return lambda s: s == want


_DIVIDE = re.compile("(?P<op>//?)")


class Parser:
    """Recursive descent over the tokens of a pattern."""

    def __init__(self, text: str, unit: str = "word"):
        self.toks, self.at, self.unit, self.text = lex(text), 0, unit, text

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if want is not None and t[1] != want:
            raise PatternError(f"expected {want!r}, found {t[1]!r} in {self.text!r}")
        self.at += 1
        return t

    def accept(self, *wants: str) -> str | None:
        if self.peek()[1] in wants and self.peek()[0] not in ("string", "regex"):
            return self.take()[1]
        return None

    # constraints

    def constraint(self) -> Test:
        self.take("[")
        test = (lambda s, i: True) if self.peek()[1] == "]" else self.disjunction()
        self.take("]")
        return test

    def disjunction(self) -> Test:
        tests = [self.conjunction()]
        while self.accept("|"):
            tests.append(self.conjunction())
        return tests[0] if len(tests) == 1 else lambda s, i: any(t(s, i) for t in tests)

    def conjunction(self) -> Test:
        tests = [self.negation()]
        while self.accept("&"):
            tests.append(self.negation())
        return tests[0] if len(tests) == 1 else lambda s, i: all(t(s, i) for t in tests)

    def negation(self) -> Test:
        if self.accept("!"):
            test = self.negation()
            return lambda s, i: not test(s, i)
        if self.peek()[1] == "(" and not self._numeric():
            self.take("(")
            test = self.disjunction()
            self.take(")")
            return test
        return self.comparison() if self._numeric() else self.atom()

    def _numeric(self) -> bool:
        """Whether a comparison of numbers starts here."""
        depth = i = 0
        while (t := self.peek(i))[0] != "end":
            if t[1] in ("]", "&", "|") and not depth and t[0] == "op":
                return False
            if t[0] == "op":
                depth += (t[1] == "(") - (t[1] == ")")
                if depth < 0:
                    return False
                if t[1] in (">=", "<=", "==", "!=", "<", ">"):
                    return True
            i += 1
        return False

    def comparison(self) -> Test:
        ops = {">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt}
        sides, signs = [self.sum()], []
        while op := self.accept(*ops):
            signs.append(ops[op])
            sides.append(self.sum())

        def test(s, i):
            values = [f(s, i) for f in sides]
            return all(sign(a, b) for sign, a, b in zip(signs, values, values[1:], strict=False))

        return test

    def sum(self):
        left = self.product()
        while op := self.accept("+", "-"):
            right, f = self.product(), operator.add if op == "+" else operator.sub
            left = (lambda a, b, f: lambda s, i: f(a(s, i), b(s, i)))(left, right, f)
        return left

    def product(self):
        def whole(a, b):  # towards the sign of the divisor
            return (1 if b > 0 else -1) * (a // abs(b))

        ops = {"*": operator.mul, "/": operator.truediv, "//": whole, "%": lambda a, b: a - abs(b) * (a // abs(b))}
        left = self.value()
        while op := self.accept(*ops):
            left = (lambda a, b, f: lambda s, i: f(a(s, i), b(s, i)))(left, self.value(), ops[op])
        return left

    def value(self):
        if op := self.accept("-", "+"):
            inner = self.value()
            return (lambda s, i: -inner(s, i)) if op == "-" else inner
        if self.accept("("):
            inner = self.sum()
            self.take(")")
            return inner
        kind, text = self.take()
        if kind == "number":
            n = float(text)
            return lambda s, i: n
        if text == "simScore":
            self.take("(")
            word = unquote(self.take()[1]).lower()
            self.take(")")
            return lambda s, i: 1.0 if (s.value("word", i) or "").lower() == word else 0.0
        raise PatternError(f"not a number: {text!r}")

    def atom(self) -> Test:
        kind, name = self.take()
        if kind == "name" and self.accept("="):
            return self.field(name)
        return self.unit_test(kind, name)

    def unit_test(self, kind: str, text: str) -> Test:
        if kind not in ("string", "regex", "name", "number"):
            raise PatternError(f"unexpected {text!r} in {self.text!r}")
        test, unit = string_test(kind, text), self.unit
        return lambda s, i: test(s.value(unit, i))

    def field(self, name: str) -> Test:
        kind, text = self.take()
        if name == "mention":
            arg = None
            if kind == "name" and "." in text:
                text, arg = text.rsplit(".", 1)
            test = string_test(kind, text)
            return lambda s, i: s.has_mention(i, test, arg)
        test = string_test(kind, text)
        if name in ("incoming", "outgoing"):
            return lambda s, i: any(test(r) for r in s.edge_labels(i, name))
        if name not in FIELDS:
            raise PatternError(f"unknown field {name!r}")
        return lambda s, i: test(s.value(name, i))

    # sequences

    def pattern(self) -> tuple:
        node = self.alternation()
        if self.peek()[0] != "end":
            raise PatternError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return node

    def alternation(self) -> tuple:
        parts = [self.sequence()]
        while self.accept("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek()[0] != "end" and not (self.peek()[0] == "op" and self.peek()[1] in ("|", ")")):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self) -> tuple:
        node = self.single()
        while True:
            if op := self.accept("?", "*", "+", "??", "*?", "+?"):
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[op[0]]
                node = ("rep", node, low, high, not op.endswith("?") or op == "?")
            elif self.peek() == ("op", "{"):
                low, high = self.bounds()
                node = ("rep", node, low, high, not self.accept("?"))
            else:
                return node

    def bounds(self) -> tuple[int, int | None]:
        self.take("{")
        low = int(self.take()[1]) if self.peek()[0] == "number" else None
        high = low
        if self.accept(","):
            high = int(self.take()[1]) if self.peek()[0] == "number" else None
        self.take("}")
        if low is None and high is None or high is not None and (low or 0) > high:
            raise PatternError(f"bad repetition in {self.text!r}")
        return low or 0, high

    def single(self) -> tuple:
        kind, text = self.peek()
        if kind == "op" and text == "[":
            return ("tok", self.constraint())
        self.take()
        if kind == "op" and text == "(":
            node = self.alternation()
            self.take(")")
            return node
        if kind == "capture":
            node = self.alternation()
            self.take(")")
            return ("cap", text[3:-1], node)
        if kind == "look":
            node = self.alternation()
            self.take(")")
            return ("look", node, "<" not in text, text.endswith("!"))
        if kind == "op" and text in "^$":
            return ("edge", text)
        if kind == "mention":
            role, _, label = text[1:].rpartition(":")
            label, _, arg = label.partition(".")
            return ("mention", label, role or None, arg or None)
        return ("tok", self.unit_test(kind, text))


def reverse(node: tuple) -> tuple:
    match node:
        case ("seq", parts):
            return ("seq", [reverse(p) for p in parts[::-1]])
        case ("alt", parts):
            return ("alt", [reverse(p) for p in parts])
        case ("rep", inner, low, high, greedy):
            return ("rep", reverse(inner), low, high, greedy)
        case ("cap", *_):
            raise PatternError("a capture inside of a look-behind")
    return node


def nullable(node: tuple) -> bool:
    match node:
        case ("seq", parts):
            return all(nullable(p) for p in parts)
        case ("alt", parts):
            return any(nullable(p) for p in parts)
        case ("rep", inner, low, _, _):
            return not low or nullable(inner)
        case ("cap", _, inner):
            return nullable(inner)
    return node[0] in ("look", "edge")


@dataclass
class Match:
    start: int
    end: int
    captures: dict = field(default_factory=dict)  # name: [(start, end)]
    mentions: dict = field(default_factory=dict)  # role: [mention]


class Program:
    """A compiled pattern."""

    def __init__(self, node: tuple):
        self.code: list[tuple] = []
        self._emit(node)
        self.code.append(("done",))
        self.cautious = self._starts_with_mention(node)

    def _starts_with_mention(self, node: tuple) -> bool:
        match node:
            case ("seq", parts):
                for p in parts:
                    if p[0] not in ("look", "edge"):
                        return self._starts_with_mention(p)
                return False
            case ("alt", parts):
                return all(self._starts_with_mention(p) for p in parts)
            case ("rep", inner, low, _, _):
                return low > 0 and self._starts_with_mention(inner)
            case ("cap", _, inner):
                return self._starts_with_mention(inner)
        return node[0] == "mention"

    def _emit(self, node: tuple) -> None:
        code = self.code
        match node:
            case ("seq", parts):
                for p in parts:
                    self._emit(p)
            case ("alt", parts):
                ends = []
                for p in parts[:-1]:
                    at = len(code)
                    code.append(())
                    self._emit(p)
                    ends.append(len(code))
                    code.append(())
                    code[at] = ("split", at + 1, len(code))
                self._emit(parts[-1])
                for e in ends:
                    code[e] = ("jump", len(code))
            case ("rep", inner, low, high, greedy):
                for _ in range(low):
                    self._emit(inner)
                if high is None:
                    at = len(code)
                    code.append(())
                    self._emit(inner)
                    code.append(("jump", at))
                    code[at] = ("split", at + 1, len(code)) if greedy else ("split", len(code), at + 1)
                else:
                    ats = []
                    for _ in range(high - low):
                        ats.append(len(code))
                        code.append(())
                        self._emit(inner)
                    for at in ats:
                        code[at] = ("split", at + 1, len(code)) if greedy else ("split", len(code), at + 1)
            case ("cap", name, inner):
                code.append(("open", name))
                self._emit(inner)
                code.append(("close", name))
            case ("look", inner, ahead, negative):
                code.append(("look", Program(inner if ahead else reverse(inner)), ahead, negative))
            case _:
                code.append(node)

    def matches(self, s, start: int, forward: bool = True) -> list[Match]:
        """The matches at `start`: the one of highest priority, or one for each of several mentions that a reference can stand for."""
        return self._explore(s, start, (0, start, (), (), ()), forward)

    def _explore(self, s, start: int, thread: tuple, forward: bool) -> list[Match]:
        n, code, seen = len(s), self.code, set()
        stack = [thread]  # instruction, place, open captures, captures, mentions
        while stack:
            pc, at, opened, caps, refs = stack.pop()
            while True:
                if (pc, at) in seen:
                    break
                seen.add((pc, at))
                op = code[pc]
                kind = op[0]
                if kind == "tok":
                    i = at if forward else at - 1
                    if not 0 <= i < n or not op[1](s, i):
                        break
                    at += 1 if forward else -1
                    pc += 1
                elif kind == "split":
                    stack.append((op[2], at, opened, caps, refs))
                    pc = op[1]
                elif kind == "jump":
                    pc = op[1]
                elif kind == "open":
                    opened = (*opened, (op[1], at))
                    pc += 1
                elif kind == "close":
                    (name, begin), opened = opened[-1], opened[:-1]
                    caps = (*caps, (name, begin, at))
                    pc += 1
                elif kind == "edge":
                    if at != (0 if op[1] == "^" else n):
                        break
                    pc += 1
                elif kind == "look":
                    if bool(op[1].matches(s, at, op[2])) == op[3]:
                        break
                    pc += 1
                elif kind == "mention":
                    found = s.mentions_at(at, op[1], op[3], forward)
                    if len(found) > 1:
                        ways = [(pc + 1, end, opened, caps, (*refs, (op[2], m)) if op[2] else refs) for end, m in found]
                        if out := [x for w in ways for x in self._explore(s, start, w, forward)]:
                            return out
                    if len(found) != 1:
                        break
                    end, m = found[0]
                    at, refs, pc = end, (*refs, (op[2], m)) if op[2] else refs, pc + 1
                else:
                    out = Match(min(start, at), max(start, at))
                    for name, a, b in caps:
                        out.captures.setdefault(name, []).append((a, b))
                    for role, m in refs:
                        out.mentions.setdefault(role, []).append(m)
                    return [out]
        return []

    def find_all(self, s) -> list[Match]:
        """Matches from left to right; without overlap, unless every path starts with a mention."""
        out, at, n = [], 0, len(s)
        first = self.code[0][1] if self.code[0][0] == "tok" else None  # most places fail at their first token
        if self.code[0] == ("edge", "^"):  # all but the first one fail
            n = min(n, 1)
        while at < n:
            if first and not first(s, at):
                at += 1
                continue
            found = [m for m in self.matches(s, at) if m.end > m.start]
            out += found
            at = min(m.end for m in found) if found and not self.cautious else at + 1
        return out


def compile_pattern(text: str, unit: str = "word") -> Program:
    node = Parser(text, unit).pattern()
    if nullable(node):
        raise PatternError(f"the pattern may match no token: {text!r}")
    return Program(node)
