"""Grammars of several rules as Catalyst expressions over nested tables, without Python workers and without a shuffle.

Rules never look beyond a sentence (but those across sentences, which are left to the kernel), so a row is a sentence, and what joins would bring together
already lies in it: tokens as arrays, edges as an array sorted by token with the place where each token's edges begin, and the mentions found so far, the state.

* A step of a path is a join with the edges of a token, by place; look-around keeps or drops a token as semi and anti joins do; a closure goes on from the tokens reached last and leaves
  out those reached before, until none are new.
* Triggers and arguments are found first; edges are only sorted in sentences that have both.
* The iterations of the fixpoint are unrolled as far as a rule's inputs can still change, which the labels that rules read and make tell beforehand. Rules that make a longer mention
  of one mention go on within the row, by an aggregate, until they make none. Other grammars whose rules feed themselves go on round by round over the sentences that got new mentions in the last one, until none did.

Not taken, and left to the kernel, which gives the same results: arithmetic, repetitions without an end of more than one token, captures that repeat, and
references to mentions other than at the beginning of a sequence of tokens of fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from .lineage import read_written, written
from .native import NativeParser, NotNative, _chars, _regex, _text_test
from .paths import _HEAD, GraphPattern
from .patterns import LAYERS, PatternError, nullable

#: Constraints that share an alphabet.
MOST_CONSTRAINTS = 8
MARK = "\u0001"
STATE = "array<struct<id: string, kind: string, labels: array<string>, start: int, end: int, found_by: string, keep: boolean, trigger_id: string, ts: int, te: int, args: array<struct<role: string, id: string, start: int, end: int>>>>"
EDGES = "array<struct<at: int, to: int, relation: string>>"
Reach = Callable[["Token"], Column]


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _each(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_empty("array<int>"))


class Token:
    """What tests of a token see: token(field), its edges, and the mentions that cover it."""

    def __init__(self, i: Column, word: Column | None = None, graph: str = "", state: str = "_state"):
        self.i, self.word, self.graph, self.state = i, word, graph, state

    def __call__(self, name: str) -> Column:
        return self.word if name == "word" and self.word is not None else F.get(F.col(f"_{LAYERS[name]}"), self.i)

    def at(self, i: Column) -> Token:
        return Token(i, None, self.graph, self.state)

    def edges(self, back: bool) -> Column:
        """The edges (at, to, relation) out of the token, or into it."""
        side = "in" if back else "out"
        return _entries(f"_{side}_{self.graph}", self.i)


def _indexed(df: DataFrame, out: str, entries: Column, wanted: Column) -> DataFrame:
    """df with `out`, entries (at, to, relation) sorted by token behind a row (token, -1) for each token, and `out`_at, the places of these rows; null unless wanted."""
    markers = F.transform(F.sequence(F.lit(0), F.size("_words")), lambda i: F.struct(i.alias("at"), F.lit(-1).alias("to"), F.lit("").alias("relation")))
    df = df.withColumn(out, F.when(wanted, F.sort_array(F.concat(markers, entries))))
    return df.withColumn(f"{out}_at", F.filter(F.transform(out, lambda e, i: F.when(e["to"] == -1, i)), lambda i: i.isNotNull()))


def _entries(index: str, i: Column) -> Column:
    """The entries of a token, by place: slicing would go through all of them."""
    first = F.get(F.col(f"{index}_at"), i)
    n = F.get(F.col(f"{index}_at"), i + 1) - first - 1
    # the index is named twice, so that the optimizer doesn't put the sorting here, into the lambda
    return F.when((n > 0) & F.col(index).isNotNull(), F.transform(F.sequence(first + 1, first + n), lambda k: F.get(F.col(index), k))).otherwise(_empty(EDGES))


class GraphParser(NativeParser):
    """The parser of token patterns and of paths, whose tests are functions from a Token to a column."""

    def __init__(self, text: str, unit: str = "word"):
        super().__init__(text, unit)
        self.reads: set[str] = set()  # labels; "" stands for any
        self.sides: set[str] = set()  # of the edges of tokens that are read

    def field(self, name: str):
        if name in ("incoming", "outgoing"):
            test = _text_test(*self.take())
            self.sides.add("in" if name == "incoming" else "out")
            return lambda token: F.exists(token.edges(name == "incoming"), lambda e: F.coalesce(test(e["relation"]), F.lit(False)))
        if name == "mention":
            kind, text = self.take()
            if kind == "name" and "." in text:
                raise NotNative("an argument of a mention in a constraint")
            test = _text_test(kind, text)
            self.reads.add("" if kind == "regex" else text.strip("'\""))
            return lambda token: F.exists(F.col(token.state), lambda m: (m["start"] <= token.i) & (token.i < m["end"]) & F.exists(m["labels"], test))
        return super().field(name)

    # paths: functions from a token to the array of tokens reached, those found first before others

    def path(self) -> Reach:
        reach = self.either()
        if self.peek()[0] != "end":
            raise PatternError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return reach

    def either(self) -> Reach:
        return _any([self.chain(), *iter(lambda: self.chain() if self.accept("|") else None, None)])

    def chain(self) -> Reach:
        parts = []
        while self.peek()[0] != "end" and not (self.peek()[0] == "op" and self.peek()[1] in ("|", ")")):
            parts.append(self.repeat())
        if not parts:
            raise PatternError(f"empty path in {self.text!r}")
        return reduce(_then, parts)

    def repeat(self) -> Reach:
        reach = self.step()
        while True:
            if op := self.accept("?", "*", "+"):
                reach = _any([_stay, reach]) if op == "?" else _closure(reach, op == "+")
            elif self.peek() == ("op", "{"):
                low, high = self.bounds()
                if not low or high is None or high < low:
                    raise PatternError(f"bad repetition in {self.text!r}")
                reach = _any([reduce(_then, [reach] * n) for n in range(low, high + 1)])
            else:
                return reach

    def step(self) -> Reach:
        kind, text = self.peek()
        if kind == "op" and text == "[":
            test = self.tests[self.constraint()]
            return lambda t: F.when(test(t), _stay(t)).otherwise(_empty("array<int>"))
        self.take()
        if kind == "look":
            if "<" in text:
                raise PatternError("look-behind in a path")
            inner, wanted = self.either(), text == "(?="
            self.take(")")
            return lambda t: F.when((F.size(inner(t)) > 0) == F.lit(wanted), _stay(t)).otherwise(_empty("array<int>"))
        if kind == "op" and text == "(":
            inner = self.either()
            self.take(")")
            return inner
        if kind == "op" and text in (">>", "<<"):
            self.sides.add("in" if text == "<<" else "out")
            return lambda t: F.array_distinct(F.transform(t.edges(text == "<<"), lambda e: e["to"]))
        back = text == "<" and kind == "op"
        if kind == "op" and text in "<>":
            kind, text = self.take()
        if kind not in ("name", "string", "regex"):
            raise PatternError(f"unexpected {text!r} in {self.text!r}")
        test = _text_test(kind, text)
        self.sides.add("in" if back else "out")
        return lambda t: F.array_distinct(F.transform(F.filter(t.edges(back), lambda e: test(e["relation"])), lambda e: e["to"]))


def _stay(t: Token) -> Column:
    return F.array(t.i)


def _any(reaches: list[Reach]) -> Reach:
    return reaches[0] if len(reaches) == 1 else lambda t: F.array_distinct(F.concat(*(r(t) for r in reaches)))


def _then(left: Reach, right: Reach) -> Reach:
    return lambda t: F.array_distinct(F.flatten(F.transform(left(t), lambda i: right(t.at(i)))))


def _closure(reach: Reach, once: bool) -> Reach:
    """All tokens that steps lead to. As many rounds as the sentence has tokens suffice; they come in groups about as large as they are many, which an empty front skips.

    A round looks for what it finds among the tokens of its group only, and a group among all those before it, so that a round doesn't go through all of them. What a group
    finds once more leads to tokens that were found before it, too, so that the order is that of looking among all of them in each round.
    """

    def run(t: Token) -> Column:
        start = F.array(t.i)
        state = F.struct((_empty("array<int>") if once else start).alias("seen"), start.alias("front"))

        def further(s: Column, _: Column) -> Column:
            new = F.array_except(F.flatten(F.transform(s["front"], lambda i: reach(t.at(i)))), s["lately"])
            return F.when(F.size(s["front"]) > 0, F.struct(F.concat(s["lately"], new).alias("lately"), new.alias("front"))).otherwise(s)

        def together(s: Column) -> Column:
            # an aggregate over one element binds what the group finds, which is named twice
            found = F.aggregate(group, F.struct(_empty("array<int>").alias("lately"), s["front"].alias("front")), further)
            bind = lambda g: F.struct(F.concat(s["seen"], F.array_except(g["lately"], s["seen"])).alias("seen"), F.array_except(g["front"], s["seen"]).alias("front"))
            return F.get(F.transform(F.array(found), bind), F.lit(0))

        group = F.sequence(F.lit(1), F.col("_root"))
        rounds = F.aggregate(group, state, lambda s, _: F.when(F.size(s["front"]) > 0, together(s)).otherwise(s))
        return rounds["seen"]

    return run


# --- token patterns


@dataclass
class Leaves:
    """A regular expression whose groups follow each other and cover its matches, and (name, first group, group after the last) of its captures."""

    regex: str
    groups: int
    captures: list[tuple[str, int, int]]


def _captures(node: tuple) -> bool:
    match node:
        case ("cap", *_):
            return True
        case ("seq" | "alt", parts):
            return any(map(_captures, parts))
        case ("rep", inner, *_) | ("look", inner, *_):
            return _captures(inner)
    return False


def _leaves(node: tuple, chars: str, first: int = 0) -> Leaves:
    if not _captures(node):
        return Leaves(f"({_regex(node, chars)})", 1, [])
    match node:
        case ("cap", name, inner):
            x = _leaves(inner, chars, first)
            return Leaves(x.regex, x.groups, [*x.captures, (name, first, first + x.groups)])
        case ("seq" | "alt" as kind, parts):
            runs: list[tuple] = []
            for p in parts:  # neighbours without captures make one group
                if kind == "seq" and runs and not _captures(p) and runs[-1][0] == "plain":
                    runs[-1][1].append(p)
                else:
                    runs.append(("plain", [p]) if kind == "seq" and not _captures(p) else ("own", p))
            found, n = [], first
            for tag, p in runs:
                found.append(_leaves(("seq", p) if tag == "plain" else p, chars, n))
                n += found[-1].groups
            regex = "".join(x.regex for x in found) if kind == "seq" else f"(?:{'|'.join(x.regex for x in found)})"
            return Leaves(regex, n - first, [c for x in found for c in x.captures])
        case ("rep", inner, low, 1, greedy):
            x = _leaves(inner, chars, first)
            return Leaves(f"(?:{x.regex}){{{low},1}}{'' if greedy else '?'}", x.groups, x.captures)
    raise NotNative("a capture that repeats")


def _width(node: tuple) -> int | None:
    """The number of tokens of a pattern, if it is always the same and nothing around it matters."""
    match node:
        case ("seq", parts):
            each = [_width(p) for p in parts]
            return None if None in each else sum(each)
        case ("alt", parts):
            each = {_width(p) for p in parts}
            return each.pop() if len(each) == 1 else None
        case ("tok", _):
            return 1
        case ("rep", inner, low, high, _) if low == high:
            one = _width(inner)
            return None if one is None else low * one
        case ("cap", _, inner):
            return _width(inner)
    return None


def _with_spans(df: DataFrame, text: str, leaves: Leaves, out: str) -> DataFrame:
    """df and `out`: for each match in the text of characters the array of places where its groups begin, and its end.

    Marks are put around the groups of each match; a mark's place, less the marks before it, is a token's.
    """
    marked = F.split(F.regexp_replace(text, leaves.regex, MARK + MARK.join(f"${g + 1}" for g in range(leaves.groups)) + MARK), "")
    marks = F.transform(F.filter(F.transform(marked, lambda c, i: F.when(c == MARK, i)), lambda i: i.isNotNull()), lambda i, k: i - k)
    df = df.withColumn(f"{out}_marks", F.when(F.col(text).rlike(leaves.regex), marks).otherwise(_empty("array<int>")))
    n = leaves.groups + 1
    found = F.transform(_each((F.size(f"{out}_marks") / n).cast("int")), lambda k: F.array(*(F.get(F.col(f"{out}_marks"), k * n + j) for j in range(n))))
    return df.withColumn(out, F.filter(found, lambda b: F.element_at(b, -1) > F.element_at(b, 1)))


# --- rules


@dataclass
class Compiled:
    rule: object
    reads: set[str]
    run: Callable[[DataFrame], tuple[DataFrame, Column]]  # rows to rows with what it needs, and its new mentions
    edges: set[tuple[str, str]]  # graph and side
    fields: set[str]
    told: bool = True  # whether its mentions may have arguments
    grows: tuple[Callable[[DataFrame], DataFrame], Callable[[Column], Column]] | None = None  # rows to rows with what it needs, and mentions to the longer one it makes of each


def _struct(**x: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in x.items())).cast(STATE[6:-1])


def _text_id(label: str, start: Column, end: Column) -> Column:
    return F.concat(F.lit(f"T:{label}:"), F.col("sent"), F.lit(":"), start, F.lit("-"), end)


def _made(rule, kind: str, start: Column, end: Column, args: Column, trigger: tuple[Column, Column, Column] | None, roles: list[str]) -> Column:
    """A mention, whose id tells its arguments by role."""
    by_role = []
    for r in sorted(set(roles)):
        ids = F.array_sort(F.transform(F.filter(args, _role_is(r)), lambda a: a["id"]))
        by_role.append(F.when(F.size(ids) > 0, F.concat(F.lit(f"{r}="), F.array_join(ids, "+"))))
    told = F.array_join(F.array_compact(F.array(*by_role)), ",") if by_role else F.lit("")
    place = F.concat(F.lit(f"{kind[0].upper()}:{rule.labels[0]}:"), F.col("sent"), F.lit(":"), start, F.lit("-"), end)
    place = F.concat(place, *([F.lit("<"), trigger[0], F.lit(">")] if trigger else []), F.when(told != "", F.concat(F.lit("("), told, F.lit(")"))).otherwise(F.lit("")))
    null = F.lit(None)
    return _struct(id=place, kind=F.lit(kind), labels=F.array(*map(F.lit, rule.labels)), start=start, end=end, found_by=F.lit(rule.name), keep=F.lit(rule.keep), trigger_id=trigger[0] if trigger else null, ts=trigger[1] if trigger else null, te=trigger[2] if trigger else null, args=args)


# Spark counts the parameters of its lambdas, so what they depend on comes from functions around them


def _role_is(role: str):
    return lambda a: a["role"] == role


def _labelled(label: str):
    return lambda m: F.array_contains(m["labels"], label)


def _key(m: Column) -> Column:
    return F.concat(m["id"], F.lit(MARK), F.array_join(m["labels"], MARK))


def _covering(index: str):
    """From a token to the places of the mentions that cover it."""
    return lambda t: F.transform(_entries(index, t), lambda e: e["to"])


def _covers(m: Column, k: Column) -> Column:
    return F.transform(F.sequence(m["start"], m["end"] - 1), lambda t: F.struct(t.alias("at"), k.alias("to"), F.lit("").alias("relation")))


def _found(reach: Reach, graph: str, index: str):
    """From a trigger to the places of the mentions that a path leads to from its tokens."""

    def run(s: Column) -> Column:
        reached = F.flatten(F.transform(F.sequence(s["start"], s["end"] - 1), lambda i: reach(Token(i, None, graph))))
        return F.array_distinct(F.flatten(F.transform(reached, _covering(index))))

    return run


def _filled(a):
    return lambda found: _groups(found, a.low, a.high, a.size)


def _inside(a: str, b: str):
    return lambda e: (e[a] >= 0) & (e[b] >= 0)


def _edge(a: str, b: str):
    return lambda e: F.struct(e[a].cast("int").alias("at"), e[b].cast("int").alias("to"), e["relation"].alias("relation"))


def _argument(role: str, id_: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), id_.alias("id"), start.alias("start"), end.alias("end"))


def _mentions_made(rule, start: Column, end: Column, captures: list[tuple[str, Column, Column]], refs: list[tuple[str, Column]]) -> Column:
    """The mention of a match: an event with a trigger, a relation with arguments, or a text. captures: (role, start, end), refs: (role, mention)."""
    args = [F.when(b > a, _argument(role, _text_id(rule.labels[0], a, b), a, b)) for role, a, b in captures if role != "trigger"]
    args += [_argument(role, m["id"], m["start"], m["end"]) for role, m in refs]
    roles = [r for r, *_ in captures if r != "trigger"] + [r for r, _ in refs]
    given = F.array_distinct(F.array_compact(F.array(*args))) if args else _empty("array<struct<role: string, id: string, start: int, end: int>>")
    plain = _made(rule, "text", start, end, _empty("array<struct<role: string, id: string, start: int, end: int>>"), None, [])
    out = F.when(F.size(given) > 0, _made(rule, "relation", start, end, given, None, roles)).otherwise(plain) if args else plain
    for role, a, b in reversed(captures):  # the first that matched is the trigger
        if role == "trigger":
            out = F.when(b > a, _made(rule, "event", start, end, given, (_text_id(rule.labels[0], a, b), a, b), roles)).otherwise(out)
    return F.filter(F.array(out), _valid)


def _valid(m: Column) -> Column:
    """No argument of an event contains its trigger."""
    return m["ts"].isNull() | ~F.exists(m["args"], lambda a: (a["start"] <= m["ts"]) & (a["end"] >= m["te"]))


def _with_text(df: DataFrame, parser: GraphParser, name: str, state: str, graph: str) -> DataFrame:
    """df and `name`: the sentence as a string in which a token is a character that says which tests it meets."""
    if len(parser.tests) > MOST_CONSTRAINTS:
        raise NotNative("too many constraints")
    chars = _chars(len(parser.tests))

    def char(word: Column, i: Column) -> Column:
        token = Token(i, word, graph, state)
        mask = sum((F.when(F.coalesce(t(token), F.lit(False)), F.lit(1 << j)).otherwise(F.lit(0)) for j, t in enumerate(parser.tests)), F.lit(0))
        return F.element_at(F.array(*map(F.lit, chars)), mask + 1)

    return df.withColumn(name, F.array_join(F.transform("_words", char), ""))


def _token_rule(rule, name: str) -> Compiled:
    parser = GraphParser(rule.source, rule.unit)
    node = parser.pattern()
    if nullable(node):
        raise NotNative("may match no token")
    parts = node[1] if node[0] == "seq" else [node]
    refs = [p for p in parts if p[0] == "mention"]
    chars = _chars(len(parser.tests)) if len(parser.tests) <= MOST_CONSTRAINTS else ""
    if not refs:
        leaves = _leaves(node, chars)

        def run(df: DataFrame) -> tuple[DataFrame, Column]:
            df = _with_text(df, parser, f"{name}_text", "_state", rule.graph)
            df = _with_spans(df, f"{name}_text", leaves, f"{name}_found")

            def made(b: Column) -> Column:
                caps = [(role, F.get(b, F.lit(x)), F.get(b, F.lit(y))) for role, x, y in leaves.captures]
                return _mentions_made(rule, F.get(b, F.lit(0)), F.element_at(b, -1), caps, [])

            return df, F.flatten(F.transform(f"{name}_found", made))

        told = bool(leaves.captures)
    else:
        told = True
        widths = [None if p[0] == "mention" else _width(p) for p in parts]
        if parts[0][0] != "mention" or any(w is None and p[0] != "mention" for w, p in zip(widths, parts, strict=True)) or any(p[3] for p in refs):
            raise NotNative("mentions other than before tokens of fixed number")
        alone = len(refs) == 1 and not parser.reads  # and no constraint reads mentions
        parser.reads |= {p[1] for p in refs}
        pieces = [None if p[0] == "mention" else _leaves(p, chars) for p in parts]

        text = f"{name}_text"

        def with_text(df: DataFrame) -> DataFrame:
            return _with_text(df, parser, text, "_state", rule.graph)

        def run(df: DataFrame) -> tuple[DataFrame, Column]:
            df = with_text(df)
            # a rule with one reference that ran in the round before finds new mentions by that round's only
            seen = "_last" if alone and "_last" in df.columns else "_state"
            for k, label in enumerate(dict.fromkeys(p[1] for p in refs)):
                df = df.withColumn(f"{name}_m{k}", F.filter(seen, _labelled(label)))
            return df, of_mentions({label: F.col(f"{name}_m{k}") for k, label in enumerate(dict.fromkeys(p[1] for p in refs))})

        def of_mentions(of: dict[str, Column]) -> Column:
            """The mentions that the rule makes of those with each label."""

            def go(k: int, start: Column | None, at: Column | None, caps: list, found: list) -> Column:
                """The mentions that the parts from the k-th on make; the earlier ones ended at `at`."""
                if k == len(parts):
                    return _mentions_made(rule, start, at, caps, found)
                p = parts[k]
                if p[0] == "mention":
                    fit = of[p[1]] if at is None else F.filter(of[p[1]], lambda m: m["start"] == at)
                    return F.flatten(F.transform(fit, lambda m: go(k + 1, m["start"] if start is None else start, m["end"], caps, [*found, (p[2], m)] if p[2] else found)))
                here = F.substring(F.col(text), at + 1, F.lit(widths[k]))
                x = pieces[k]
                more, places = [], []
                if x.captures:  # places of the groups, from the lengths of those before
                    sizes = [F.length(F.regexp_extract(here, f"^{x.regex}$", g + 1)) for g in range(x.groups)]
                    places = [at + sum(sizes[:g], F.lit(0)) for g in range(x.groups + 1)]
                    more = [(role, places[a], places[b]) for role, a, b in x.captures]
                fits = (F.length(here) == widths[k]) & here.rlike(f"^{x.regex}$")
                return F.when(fits, go(k + 1, start, at + widths[k], [*caps, *more], found)).otherwise(_empty(STATE))

            return go(0, None, None, [], [])

    made = Compiled(rule, parser.reads, run, {(rule.graph, x) for x in parser.sides}, {LAYERS[f] for f in parser.fields}, told)
    if refs and alone and refs[0][2] and sum(w or 0 for w in widths) > 0 and not parser.sides:
        label = refs[0][1]
        made.grows = with_text, lambda seen: of_mentions({label: F.filter(seen, _labelled(label))})
    return made


def _combinations(found: Column, size: int) -> Column:
    """Arrays of `size` of the elements, in their order."""
    places = F.transform(_each(F.size(found)), lambda p: F.array(p))
    for _ in range(size - 1):
        places = F.flatten(F.transform(places, lambda c: F.transform(F.filter(_each(F.size(found)), lambda p: p > F.element_at(c, -1)), lambda p: F.concat(c, F.array(p)))))
    return F.transform(places, lambda c: F.transform(c, lambda p: F.get(found, p)))


def _groups(found: Column, low: int, high: int | None, size: int | None) -> Column:
    """The ways in which the mentions found for a role fill it: none if they are too few, an empty one if the role may stay empty."""
    if size is not None:
        some = _combinations(found, size)
    elif high is None:
        some = F.array(found)
    else:
        some = F.when(F.size(found) <= high, F.array(found)).otherwise(_combinations(found, high))
    none = F.array(_empty("array<int>")) if low == 0 else _empty("array<array<int>>")
    return F.when(F.size(found) < max(low, 1), none).otherwise(some)


def _graph_rule(rule, name: str) -> Compiled:
    p: GraphPattern = rule.pattern
    if p.anchor and p.anchor[0] in {a.name for a in p.arguments}:
        raise NotNative("an anchor named like an argument")
    text = "\n".join(re.sub(r"(?<!\S)#.*$", "", line) for line in rule.source.strip().split("\n"))
    heads = list(_HEAD.finditer(text))
    bodies = [text[m.end() : n.start() if n else len(text)].strip() for m, n in zip(heads, [*heads[1:], None], strict=True)]
    parsers = [GraphParser(b, rule.unit) for b in bodies[1:]]
    reaches = [x.path() for x in parsers]
    trigger = None
    if p.trigger is not None:
        trigger = GraphParser(bodies[0], rule.unit)
        node = trigger.pattern()
        if nullable(node) or _has_mention(node):
            raise NotNative("a trigger of mentions")
        leaves = Leaves(f"({_regex(_plain(node), _chars(len(trigger.tests)))})" if len(trigger.tests) <= MOST_CONSTRAINTS else "", 1, [])
    every = [*parsers, *([trigger] if trigger else [])]
    labels = [a.label for a in p.arguments]
    head = p.trigger_label or (p.anchor[1] if p.anchor else None)
    reads = {x for q in every for x in q.reads} | set(labels) | ({head} if head else set())
    graphs = {(rule.graph, x) for q in every for x in q.sides}

    def run(df: DataFrame) -> tuple[DataFrame, Column]:
        for k, label in enumerate(dict.fromkeys(labels)):
            df = df.withColumn(f"{name}_m{k}", F.filter("_state", _labelled(label)))
        of = {label: f"{name}_m{k}" for k, label in enumerate(dict.fromkeys(labels))}
        if trigger:
            df = _with_text(df, trigger, f"{name}_text", "_state", rule.graph)
            df = _with_spans(df, f"{name}_text", leaves, f"{name}_spans")
            spans = F.transform(f"{name}_spans", lambda b: F.struct(_text_id(rule.labels[0], F.get(b, F.lit(0)), F.get(b, F.lit(1))).alias("id"), F.get(b, F.lit(0)).alias("start"), F.get(b, F.lit(1)).alias("end")))
        else:
            heads = F.filter("_state", lambda m: F.array_contains(m["labels"], head) & ((m["kind"] == "text") if p.trigger_label else F.lit(True)))
            spans = F.transform(heads, lambda m: F.struct(m["id"].alias("id"), m["start"].alias("start"), m["end"].alias("end")))
        needed = [F.size(of[a.label]) > 0 for a in p.arguments if a.low > 0]
        df = df.withColumn(f"{name}_all", spans)
        df = df.withColumn(f"{name}_starts", F.when(reduce(lambda a, b: a & b, needed, F.size(f"{name}_all") > 0), F.col(f"{name}_all")).otherwise(F.slice(f"{name}_all", 1, 0)))
        for m in of.values():  # the mentions by token
            df = _indexed(df, f"{m}_by", F.flatten(F.transform(m, _covers)), F.size(f"{name}_starts") > 0)
        for k, (a, reach) in enumerate(zip(p.arguments, reaches, strict=True)):  # columns of their own: expressions stay shallow, and nothing is done again for each combination
            df = df.withColumn(f"{name}_f{k}", F.transform(f"{name}_starts", _found(reach, rule.graph, f"{of[a.label]}_by")))
            df = df.withColumn(f"{name}_g{k}", F.transform(f"{name}_f{k}", _filled(a)))

        def one(s: Column, j: Column) -> Column:
            def go(k: int, args: list[Column], roles: list[str]) -> Column:
                if k < len(p.arguments):
                    a = p.arguments[k]

                    def with_group(g: Column) -> Column:
                        each = F.transform(g, lambda i: F.get(F.col(of[a.label]), i))
                        return go(k + 1, [*args, F.transform(each, lambda m: _argument(a.name, m["id"], m["start"], m["end"]))], [*roles, a.name])

                    return F.flatten(F.transform(F.get(F.col(f"{name}_g{k}"), j), with_group))
                given = F.concat(*args) if args else _empty("array<struct<role: string, id: string, start: int, end: int>>")
                if p.anchor:
                    given = F.concat(F.array(_argument(p.anchor[0], s["id"], s["start"], s["end"])), given)
                starts, ends = F.transform(given, lambda x: x["start"]), F.transform(given, lambda x: x["end"])
                begin, end = F.array_min(F.concat(F.array(s["start"]), starts)), F.array_max(F.concat(F.array(s["end"]), ends))
                if p.anchor:
                    return F.array(_made(rule, "relation", begin, end, given, None, [p.anchor[0], *roles]))
                return F.filter(F.array(_made(rule, "event", begin, end, given, (s["id"], s["start"], s["end"]), roles)), _valid)

            return go(0, [], [])

        filled = reduce(lambda a, b: a & b, [F.size(f"{name}_g{k}") > 0 for k in range(len(p.arguments))], F.size(f"{name}_starts") > 0)
        return df, F.when(filled, F.flatten(F.transform(f"{name}_starts", one))).otherwise(_empty(STATE))

    return Compiled(rule, reads, run, graphs, {LAYERS[f] for q in every for f in q.fields})


def _has_mention(node: tuple) -> bool:
    match node:
        case ("seq" | "alt", parts):
            return any(map(_has_mention, parts))
        case ("rep", inner, *_) | ("look", inner, *_):
            return _has_mention(inner)
        case ("cap", _, inner):
            return _has_mention(inner)
    return node[0] == "mention"


def _plain(node: tuple) -> tuple:
    """The pattern without its captures."""
    match node:
        case ("seq" | "alt" as kind, parts):
            return (kind, [_plain(p) for p in parts])
        case ("cap", _, inner):
            return _plain(inner)
        case ("rep", inner, *rest):
            return ("rep", _plain(inner), *rest)
        case ("look", inner, *rest):
            return ("look", _plain(inner), *rest)
    return node


def compile_rules(rules: list) -> list[Compiled]:
    out = []
    for k, r in enumerate(rules):
        if r.kind == "cross-sentence":
            raise NotNative("a rule across sentences")
        out.append((_token_rule if r.kind == "token" else _graph_rule)(r, f"_r{k}"))
    return out


def _feeds(made: set[str], reads: set[str]) -> bool:
    return bool(made) and ("" in reads or bool(made & reads))


def _recursive(compiled: list[Compiled]) -> bool:
    """Whether a rule reads, through others, what it makes."""
    feeds = {i: {j for j, d in enumerate(compiled) if _feeds(set(c.rule.labels), d.reads)} for i, c in enumerate(compiled)}

    def reached(i: int) -> set[int]:
        seen, front = set(), {i}
        while front:
            front = {k for j in front for k in feeds[j]} - seen
            seen |= front
        return seen

    return any(i in reached(i) for i in feeds)


def _growing(running: list[Compiled], compiled: list[Compiled]) -> list[Compiled] | None:
    """The rules that read mentions, if each makes one longer mention at most of each mention, which no other rule makes too; none otherwise."""
    of = [c for c in running if c.reads]
    labels = [c.rule.labels for c in of]
    others = {c.rule.labels for c in compiled if c.told and c not in of}
    firsts = [x[0] for x in {c.rule.labels for c in compiled}]
    fine = all(c.grows for c in of) and len(set(labels)) == len(labels) and not others & set(labels) and len(set(firsts)) == len(firsts)
    return of if of and fine else None


def _grown(df: DataFrame, growing: list[Compiled]) -> DataFrame:
    """df, of which `_last` are the mentions of the last iteration, with all those in the state that growing rules make of them, and of these, until there are none.

    Mentions get longer in each round, so as many rounds as the sentence has tokens suffice; they come in groups, as those of a closure do.
    """
    for c in growing:
        df = c.grows[0](df)
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  binds what is named twice

    def further(s: Column, _: Column) -> Column:
        new = F.concat(*(c.grows[1](s["front"]) for c in growing))
        return F.when(F.size(s["front"]) > 0, once(new, lambda n: F.struct(F.concat(s["made"], n).alias("made"), n.alias("front")))).otherwise(s)

    def together(s: Column, _: Column) -> Column:
        found = F.aggregate(group, F.struct(_empty(STATE).alias("made"), s["front"].alias("front")), further)
        return F.when(F.size(s["front"]) > 0, once(found, lambda g: F.struct(F.concat(s["made"], g["made"]).alias("made"), g["front"].alias("front")))).otherwise(s)

    group = F.sequence(F.lit(1), F.col("_root"))
    made = F.aggregate(group, F.struct(_empty(STATE).alias("made"), F.col("_last").alias("front")), together, lambda s: s["made"])
    return df.withColumn("_state", F.concat("_state", F.when(F.size("_last") > 0, made).otherwise(_empty(STATE))))


def _with_edges(df: DataFrame, graph: str, side: str, present: bool, wanted: Column) -> DataFrame:
    """df with an index of the edges out of the tokens, or into them."""
    a, b = ("source", "destination") if side == "out" else ("destination", "source")
    given = F.coalesce(F.element_at(F.col("_graphs"), graph), F.expr("cast(array() as array<struct<source: int, destination: int, relation: string>>)")) if present else None
    return _indexed(df, f"_{side}_{graph}", F.transform(F.filter(given, _inside(a, b)), _edge(a, b)) if present else _empty(EDGES), wanted)


def mentions(docs: DataFrame, keys: list[str], rules: list, last: int = 1000) -> DataFrame:
    """The mentions of a grammar, in the columns of rules.extract()."""
    compiled = compile_rules(rules)
    element = docs.schema["sentences"].dataType.elementType
    if not isinstance(element, StructType):
        raise NotNative("sentences aren't structs")
    layers = set(element.names)
    needed = set().union(*(c.fields for c in compiled)) if compiled else set()
    if not needed <= layers:
        raise NotNative("a layer that sentences don't have")
    graphs = sorted(set().union(*(c.edges for c in compiled))) if compiled else []
    present = bool(graphs) and "graphs" in layers
    if present and not isinstance(element["graphs"].dataType, MapType):
        raise NotNative("graphs aren't a map")
    used = sorted({"words"} | needed | (layers & {"raw", "starts", "ends"}) | ({"graphs"} if present else set()))
    zipped = F.arrays_zip(*(F.col(f"sentences.{n}").alias(n) for n in used))  # each layer alone, so that others aren't even built
    row = F.struct(*keys).alias("_keys")
    df = docs.select(row, F.posexplode_outer(zipped).alias("sent", "s")).select("_keys", "sent", *(F.col(f"s.{n}").alias(f"_{n}") for n in used))
    df = df.where(F.size("_words") > 0).withColumn("_state", _empty(STATE)).withColumn("_root", F.ceil(F.sqrt(F.size("_words") + 1)).cast("int"))
    kept = ["_keys", "sent", *(f"_{n}" for n in used), "_root", "_state"]
    dense: set[tuple[str, str]] = set()
    sides = lambda g: [f"_{g[1]}_{g[0]}", f"_{g[1]}_{g[0]}_at"]

    def iterate(df: DataFrame, running: list[Compiled], ever: set[int]) -> DataFrame:
        """One iteration: all rules read the state of the one before; `_new` are the mentions that it lacks."""
        for g in sorted({g for c in running for g in c.edges} - dense):
            anyway = any(not c.reads for c in running if g in c.edges)  # constraints on edges in patterns that read no mentions
            df = _with_edges(df, *g, present, F.lit(True) if anyway else F.size("_state") > 0)
            if anyway:
                dense.add(g)
        made = []
        for c in running:
            df, new = c.run(df)
            made.append((c, new))
        df = df.select(*kept, *(x for g in sorted(dense) for x in sides(g)), *(new.alias(f"_new{k}") for k, (_, new) in enumerate(made)))
        total = _empty(STATE)
        labels = [c.rule.labels for c in compiled]
        for k, (c, _) in enumerate(made):
            name, alone = f"_new{k}", labels.count(c.rule.labels) == 1 and id(c) not in ever
            if alone:
                fresh = F.col(name)
                if c.rule.kind != "token":  # keys are told apart by hashing, structs pair by pair
                    fresh = F.when(F.size(F.array_distinct(F.transform(name, _key))) == F.size(name), fresh).otherwise(F.array_distinct(name))
            else:  # the same mention by another rule, or by an earlier run of this one
                df = df.withColumns({"_known": F.transform(F.concat("_state", total), _key), "_told": F.transform(name, _key)})
                df = df.withColumn("_left", F.array_except("_told", "_known"))
                some = F.transform("_left", lambda k: F.get(F.col(name), F.array_position("_told", k).cast("int") - 1))
                fresh = F.when(F.size("_left") == F.size(name), F.col(name)).otherwise(some)
            df = df.withColumn("_fresh", fresh)
            total = F.concat(total, "_fresh")
            df = df.withColumn("_sum", total).drop(name)
            total = F.col("_sum")
        return df.withColumn("_new", total if made else _empty(STATE)).drop("_sum", "_fresh", "_known", "_told", "_left").withColumn("_state", F.concat("_state", "_new"))

    least = max((r.least for r in rules), default=0)
    ever: set[int] = set()
    changed: set[str] = set()
    if not _recursive(compiled):
        iteration, pending = 0, list(compiled)
        while True:
            iteration += 1
            running = [c for c in compiled if c.rule.runs(iteration) and (c in pending or _feeds(changed, c.reads))]
            waits = [c for c in compiled if not c.rule.runs(iteration) and (c in pending or _feeds(changed, c.reads))]
            if running:
                df = iterate(df, running, ever).drop("_new")
                ever |= {id(c) for c in running}
            changed = {x for c in running for x in c.rule.labels}
            pending = waits
            if iteration >= least and not running:
                break
            if iteration > last:
                raise PatternError(f"no fixpoint after {last} iterations")
        out = df
    else:
        done, settled = [], max(least, max(r.low for r in rules))
        for iteration in range(1, last + 2):
            if iteration > last:
                raise PatternError(f"no fixpoint after {last} iterations")
            running = [c for c in compiled if c.rule.runs(iteration)]
            df = iterate(df, running, ever)
            ever |= {id(c) for c in running}
            if iteration < least:
                df = df.drop("_new")
                continue
            if iteration >= settled and (growing := _growing([c for c in compiled if c.rule.runs(iteration + 1)], compiled)):
                df = _grown(written(df.withColumnRenamed("_new", "_last")), growing).select(*kept)
                break
            if iteration < settled and _growing([c for c in compiled if c.rule.runs(settled + 1)], compiled):
                df = df.drop("_new")
                continue
            df = written(df)  # of which only the sentences that changed go on
            done.append(df)
            df = df.where("size(_new) > 0")
            # after the last iteration that a rule begins or ends at, all rules have read all but the last mentions
            df = df.withColumnRenamed("_new", "_last") if iteration > settled else df.drop("_new")
            if df.isEmpty():
                break
        # one scan of all rounds' tables, as each task of a union would carry the metrics of every one of them to the driver
        out = read_written(done, [*kept, "_new"]).where("size(_new) = 0").drop("_new") if done else df
    # an outer generator, as the optimizer would put a filter on the state, with all that it is made of, beneath another one
    out = out.select("_keys", "sent", *(f"_{n}" for n in used if n != "graphs"), F.inline_outer(F.filter("_state", lambda m: m["keep"]))).where("id is not null")
    raw = F.coalesce("_raw", "_words") if "raw" in used else F.col("_words")
    plain = F.array_join(F.slice(raw, F.col("start") + 1, F.col("end") - F.col("start")), " ")
    if {"starts", "ends"} <= set(used):
        spaced = F.array_join(F.transform(F.sequence(F.col("start"), F.col("end") - 1), lambda i: F.concat(F.when(i > F.col("start"), F.repeat(F.lit(" "), F.greatest(F.lit(0), F.get("_starts", i) - F.get("_ends", i - 1)))).otherwise(F.lit("")), F.get(raw, i))), "")
        plain = F.when((F.size("_starts") > 0) & (F.size("_ends") > 0), spaced).otherwise(plain)
    args = F.transform("args", lambda a: F.struct(a["role"].alias("role"), a["id"].alias("mention_id")))
    return out.select("_keys.*", F.col("id").alias("mention_id"), "kind", "labels", "sent", "start", "end", plain.alias("text"), "trigger_id", "found_by", args.alias("args"))
