"""Rule grammars over annotated documents: YAML to rules, and extraction to a fixpoint.

State never crosses documents, so the fixpoint of a document runs within one task and nothing is shuffled: most grammars become expressions over
nested tables (nested.py), and extract() is one Arrow pass that turns documents into mentions for the others. Within an iteration all rules read the state of the one before.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .native import NotNative
from .paths import GraphPattern, compile_graph
from .patterns import LAYERS, PatternError, Program, compile_pattern

# The named graphs of a sentence.
GRAPHS = ("universal-basic", "universal-enhanced", "stanford-basic", "stanford-collapsed", "semantic-roles", "enhanced-semantic-roles", "hybrid-dependencies")
DEFAULT_GRAPH = "universal-enhanced"


@dataclass(frozen=True)
class Mention:
    kind: str  # text, event, relation, cross
    labels: tuple[str, ...]
    sent: int
    start: int
    end: int
    found_by: str = field(default="", compare=False)
    keep: bool = field(default=True, compare=False)
    trigger: Mention | None = None
    args: tuple[tuple[str, tuple[Mention, ...]], ...] = ()
    paths: tuple = field(default=(), compare=False)
    attachments: tuple = ()

    @property
    def label(self) -> str:
        return self.labels[0]

    def of(self, role: str) -> tuple[Mention, ...]:
        return dict(self.args).get(role, ())

    def matches(self, label: str) -> bool:
        return label in self.labels

    def precedes(self, other: Mention) -> bool:
        return (self.sent, self.end) <= (other.sent, other.start) if self.sent == other.sent else self.sent < other.sent

    def valid(self) -> bool:
        """An event's argument may not contain its trigger."""
        t = self.trigger
        return t is None or not any(m.sent == t.sent and m.start <= t.start and m.end >= t.end for _, ms in self.args for m in ms)

    def scatter(self, role: str, size: int) -> list[Mention]:
        """A mention for each combination of `size` arguments of the role."""
        return [replace(self, args=tuple((r, c if r == role else ms) for r, ms in self.args)) for c in itertools.combinations(self.of(role), size)]

    def without(self, role: str) -> Mention:
        return replace(self, args=tuple(x for x in self.args if x[0] != role))

    def with_argument(self, role: str, *found: Mention) -> Mention:
        return replace(self, args=(*(x for x in self.args if x[0] != role), (role, (*self.of(role), *found))))


def _spanning(kind: str, labels, sent: int, found_by: str, keep: bool, args: dict, trigger: Mention | None = None, paths=()) -> Mention:
    """A mention over its trigger and those arguments that are in the sentence."""
    inside = [m for ms in args.values() for m in ms if m.sent == sent] + ([trigger] if trigger else [])
    packed = tuple((r, tuple(ms)) for r, ms in args.items())
    return Mention(kind, labels, sent, min(m.start for m in inside), max(m.end for m in inside), found_by, keep, trigger, packed, paths)


class State:
    """Mentions by sentence and token."""

    def __init__(self, mentions: list[Mention] = ()):
        self.known: dict[Mention, None] = {}
        self.at: dict[tuple[int, int], list[Mention]] = {}
        self.add(mentions)

    def add(self, mentions) -> None:
        for m in mentions:
            if m not in self.known:
                self.known[m] = None
                for i in range(m.start, m.end):
                    self.at.setdefault((m.sent, i), []).append(m)

    def mentions(self, sent: int, tok: int, label: str | None = None) -> list[Mention]:
        return [m for m in self.at.get((sent, tok), ()) if label is None or label in m.labels]

    def all(self) -> list[Mention]:
        return [m for m in self.known if m.keep]


class View:
    """A sentence as patterns see it."""

    def __init__(self, layers: dict, sent: int, state: State, graph: str = DEFAULT_GRAPH):
        self.layers, self.sent, self.state = layers, sent, state
        self.by_field = {name: layers.get(layer) for name, layer in LAYERS.items()}
        self.graph, self.indexed = graph, None
        self.size = len(layers.get("words") or ())  # null words are none

    @property
    def index(self) -> tuple[dict[int, list], dict[int, list]]:
        """Edges out of and into each token, made when first asked for."""
        if self.indexed is None:
            out, into = {}, {}
            for e in (dict(self.layers.get("graphs") or ())).get(self.graph) or ():
                out.setdefault(e["source"], []).append((e["destination"], e["relation"]))
                into.setdefault(e["destination"], []).append((e["source"], e["relation"]))
            for each in (out, into):
                for x in each.values():
                    x.sort()
            self.indexed = out, into
        return self.indexed

    def __len__(self) -> int:
        return self.size

    def value(self, name: str, i: int) -> str:
        layer = self.by_field[name]
        if layer is None:
            raise PatternError(f"sentence has no {LAYERS[name]}")
        return layer[i]

    def edges(self, i: int, back: bool) -> list[tuple[int, str]]:
        return self.index[back].get(i, [])

    def edge_labels(self, i: int, direction: str) -> list[str]:
        return [r for _, r in self.edges(i, direction == "incoming")]

    def has_mention(self, i: int, test: Callable, arg: str | None) -> bool:
        found = [m for m in self.state.mentions(self.sent, i) if any(map(test, m.labels))]
        if arg is None:
            return bool(found)
        inside = lambda x: x.sent == self.sent and x.start <= i < x.end
        return any(inside(x) for m in found for x in ((m.trigger,) if arg == "trigger" and m.trigger else m.of(arg)))

    def mentions_at(self, at: int, label: str, arg: str | None, forward: bool) -> list[tuple[int, Mention]]:
        """(place after it, mention), for mentions, or arguments of mentions, that begin at the place, or end there."""
        i = at if forward else at - 1
        found = self.state.mentions(self.sent, i, label)
        if arg is not None:
            found = [x for m in found for x in ((m.trigger,) if arg == "trigger" and m.trigger else m.of(arg))]
        fit = [m for m in found if m.sent == self.sent and (m.start == at if forward else m.end == at)]
        return [(m.end if forward else m.start, m) for m in dict.fromkeys(fit)]


@dataclass
class Rule:
    name: str
    labels: tuple[str, ...]
    kind: str
    pattern: object
    low: int  # first iteration
    high: int | None  # last; None: no end
    only: tuple[int, ...] | None
    keep: bool = True
    action: str = "default"
    graph: str = DEFAULT_GRAPH
    window: tuple[int, int] = (0, 0)
    source: str = ""
    unit: str = "word"

    def runs(self, iteration: int) -> bool:
        if self.only is not None:
            return iteration in self.only
        return iteration >= self.low and (self.high is None or iteration <= self.high)

    @property
    def least(self) -> int:
        return max(self.only) if self.only else self.high or self.low


class Taxonomy:
    """Labels and what they are kinds of, from a nested YAML forest."""

    def __init__(self, forest=()):
        self.parent: dict[str, str | None] = {}

        def walk(node, above):
            if isinstance(node, dict):
                if len(node) != 1:
                    raise PatternError("a taxonomy node has one key")
                ((name, below),) = node.items()
                self._add(str(name), above)
                for x in below or ():
                    walk(x, str(name))
            else:
                self._add(str(node), above)

        for x in forest or ():
            walk(x, None)

    def _add(self, name: str, above: str | None) -> None:
        if name in self.parent:
            raise PatternError(f"{name!r} twice in the taxonomy")
        self.parent[name] = above

    def hypernyms(self, name: str) -> list[str]:
        if name not in self.parent:
            raise PatternError(f"{name!r} isn't in the taxonomy")
        out = []
        while name is not None:
            out.append(name)
            name = self.parent[name]
        return out

    def hyponyms(self, name: str) -> list[str]:
        return [x for x in self.parent if name in self.hypernyms(x)]

    def isa(self, low: str, high: str) -> bool:
        return high in self.hypernyms(low)

    def __contains__(self, name: str) -> bool:
        return name in self.parent


def priority(text) -> tuple[int, int | None, tuple[int, ...] | None]:
    """`3`, `2-4`, `1+` or `[1, 3]`."""
    if isinstance(text, list):
        return min(text), max(text), tuple(text)
    text = str(text).strip()
    if m := re.fullmatch(r"(\d+)\s*\+", text):
        return int(m[1]), None, None
    if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", text):
        return int(m[1]), int(m[2]), None
    if m := re.fullmatch(r"\[(.*)\]", text):
        return priority([int(x) for x in m[1].split(",")])
    return int(text), int(text), None


def _substitute(value, variables: dict):
    if isinstance(value, str):
        for _ in range(20):
            new = re.sub(r"\$\{\s*([\w-]+)\s*\}", lambda m: _text(variables, m[1]), value)
            if new == value:
                return value
            value = new
        raise PatternError(f"variables in a circle in {value!r}")
    if isinstance(value, list):
        return [_substitute(x, variables) for x in value]
    if isinstance(value, dict):
        return {k: _substitute(x, variables) for k, x in value.items()}
    return value


def _text(variables: dict, name: str) -> str:
    if name not in variables:
        raise PatternError(f"no variable {name!r}")
    v = variables[name]
    return "|".join(map(str, v)) if isinstance(v, list) else str(v)


def read_rules(text: str, files: dict[str, str] | None = None) -> list[Rule]:
    """Rules of a grammar: a list of rules, or a master with taxonomy, vars, graph and rules. files: what imports name."""
    top = yaml.safe_load(text)
    master = top if isinstance(top, dict) else {"rules": top or []}
    forest = master.get("taxonomy")
    taxonomy = Taxonomy(yaml.safe_load(files[forest]) if isinstance(forest, str) else forest) if forest else None
    graph = master.get("graph", DEFAULT_GRAPH)
    rules = [_rule(r, taxonomy, graph) for r in _expand(master.get("rules") or [], master.get("vars") or {}, files or {})]
    names = [r.name for r in rules]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise PatternError(f"rules with the same name: {twice}")
    return rules


def _expand(entries: list, variables: dict, files: dict) -> Iterator[dict]:
    for e in entries:
        if "import" in e:
            inner = yaml.safe_load(files[_substitute(e["import"], variables)])
            own = inner.get("vars") or {} if isinstance(inner, dict) else {}
            below = inner.get("rules") or [] if isinstance(inner, dict) else inner
            yield from _expand(below, {**own, **variables, **(e.get("vars") or {})}, files)
        else:
            yield _substitute(e, variables)


def _rule(e: dict, taxonomy: Taxonomy | None, graph: str) -> Rule:
    for k in ("name", "label", "pattern"):
        if k not in e:
            raise PatternError(f"a rule without {k}: {e}")
    given = e["label"] if isinstance(e["label"], list) else [e["label"]]
    labels = tuple(dict.fromkeys(x for g in given for x in (taxonomy.hypernyms(g) if taxonomy else [g])))
    kind, unit = e.get("type", "graph"), e.get("unit", "word")
    graph = e.get("graph", graph) if kind != "dependency" else DEFAULT_GRAPH
    if graph not in GRAPHS:
        raise PatternError(f"unknown graph {graph!r}")
    window = (int(e.get("left-window", 0)), int(e.get("right-window", 0)))
    if kind == "token":
        pattern = compile_pattern(e["pattern"], unit)
    elif kind in ("graph", "dependency"):
        pattern = compile_graph(e["pattern"], unit)
    elif kind == "cross-sentence":
        parts = re.findall(r"^\s*([\w-]+)\s*(?::\s*([\w-]+))?\s*=\s*(.+?)\s*$", e["pattern"], re.M)
        if len(parts) != 2 or max(window) < 1:
            raise PatternError(f"a cross-sentence rule has two roles and a window: {e['name']}")
        pattern = [(role, label or None, compile_pattern(p, unit)) for role, label, p in parts]
    else:
        raise PatternError(f"unknown type {kind!r}")
    keep = str(e.get("keep", True)).lower() in ("true", "yes", "y", "on", "1")
    return Rule(str(e["name"]), labels, kind, pattern, *priority(e.get("priority", "1+")), keep, e.get("action", "default"), graph, window, str(e["pattern"]), unit)


def _token_rule(rule: Rule, view: View) -> list[Mention]:
    out = []
    for m in rule.pattern.find_all(view):
        args: dict[str, list] = {}
        for role, spans in m.captures.items():
            args[role] = [Mention("text", rule.labels, view.sent, a, b, rule.name, rule.keep) for a, b in dict.fromkeys(spans) if b > a]
        for role, found in m.mentions.items():
            args[role] = list(dict.fromkeys([*args.get(role, []), *found]))
        args = {r: x for r, x in args.items() if x}
        trigger = args.pop("trigger", None)
        if trigger:
            made = Mention("event", rule.labels, view.sent, m.start, m.end, rule.name, rule.keep, trigger[0], tuple((r, tuple(x)) for r, x in args.items()))
        elif args:
            made = Mention("relation", rule.labels, view.sent, m.start, m.end, rule.name, rule.keep, None, tuple((r, tuple(x)) for r, x in args.items()))
        else:
            made = Mention("text", rule.labels, view.sent, m.start, m.end, rule.name, rule.keep)
        out.append(made)
    return out


def _graph_rule(rule: Rule, view: View) -> list[Mention]:
    p: GraphPattern = rule.pattern
    state, sent = view.state, view.sent
    if p.trigger is not None:
        starts = [Mention("text", rule.labels, sent, m.start, m.end, rule.name, rule.keep) for m in p.trigger.find_all(view)]
    else:
        label = p.trigger_label or p.anchor[1]
        starts = list(dict.fromkeys(m for i in range(len(view)) for m in state.mentions(sent, i, label)))
        if p.trigger_label:
            starts = [m for m in starts if m.kind == "text"]
    out = []
    for start in starts:
        choices = []
        for a in p.arguments:
            found: dict[Mention, tuple] = {}
            for i in range(start.start, start.end):
                for tok, path in a.step(view, i):
                    for m in state.mentions(sent, tok, a.label):
                        found.setdefault(m, path)
            if len(found) < a.low:
                break
            if not found:
                continue
            if a.size is not None:
                groups = list(itertools.combinations(found, a.size))
            else:
                groups = [tuple(found)] if a.high is None or len(found) <= a.high else list(itertools.combinations(found, a.high))
            choices.append([(a.name, g, tuple((a.name, m, found[m]) for m in g)) for g in groups])
        else:
            for chosen in itertools.product(*choices):
                args = {name: list(g) for name, g, _ in chosen}
                paths = tuple(x for _, _, ps in chosen for x in ps)
                if p.anchor:
                    args = {p.anchor[0]: [start], **args}
                    out.append(_spanning("relation", rule.labels, sent, rule.name, rule.keep, args, None, paths))
                else:
                    out.append(_spanning("event", rule.labels, sent, rule.name, rule.keep, args, start, paths))
    return out


def _cross_rule(rule: Rule, views: list[View]) -> list[Mention]:
    """Two mentions, by patterns that must span known mentions, in sentences no further apart than the window."""
    (role, label, anchor), (other_role, other_label, other) = rule.pattern
    out = []

    def found(view: View, program: Program, label: str | None) -> list[Mention]:
        spans = [(m.start, m.end) for m in program.find_all(view)]
        return [m for a, b in spans for m in view.state.mentions(view.sent, a, label) if (m.start, m.end) == (a, b)]

    for i, view in enumerate(views):
        near = [j for j in range(max(0, i - rule.window[0]), min(len(views), i + rule.window[1] + 1)) if j != i]
        if near and (here := found(view, anchor, label)):
            for j in near:
                for a in here:
                    for b in found(views[j], other, other_label):
                        args = ((role, (a,)), (other_role, (b,)))
                        out.append(Mention("cross", rule.labels, a.sent, a.start, a.end, rule.name, rule.keep, None, args))
    return out


Action = Callable[[list[Mention], State], list[Mention]]


def extract_from(sentences: list[dict], rules: list[Rule], actions: dict[str, Action] | None = None, seeds: list[Mention] = (), last: int = 1000) -> list[Mention]:
    """All mentions of a document that rules of `keep` find, and the seeds. actions: by name; `global` runs after each iteration."""
    actions = actions or {}
    state = State(list(seeds))
    least = max((r.least for r in rules), default=0)
    for iteration in range(1, last + 1):
        graphs = {r.graph for r in rules}
        views = {g: [View(s, i, state, g) for i, s in enumerate(sentences)] for g in graphs}
        new: list[Mention] = []
        for rule in rules:
            if rule.runs(iteration):
                act = actions.get(rule.action, lambda ms, _: ms)
                if rule.kind == "cross-sentence":
                    new += act(_cross_rule(rule, views[rule.graph]), state)
                else:
                    run = _token_rule if rule.kind == "token" else _graph_rule
                    for view in views[rule.graph]:
                        if found := run(rule, view):
                            new += act(found, state)
        if "global" in actions:
            new = actions["global"](new, state)
        new = [m for m in new if m.valid() and m not in state.known]
        if not new and iteration >= least:
            return state.all()
        state.add(new)
    raise PatternError(f"no fixpoint after {last} iterations")


MENTION = "mention_id string, kind string, labels array<string>, sent int, start int, end int, text string, trigger_id string, found_by string, args array<struct<role: string, mention_id: string>>"


def _id(m: Mention) -> str:
    args = ",".join(f"{r}={'+'.join(sorted(map(_id, ms)))}" for r, ms in sorted(m.args, key=lambda x: x[0]))
    return f"{m.kind[0].upper()}:{m.label}:{m.sent}:{m.start}-{m.end}" + (f"<{_id(m.trigger)}>" if m.trigger else "") + (f"({args})" if args else "")


def text_of(sentence: dict, start: int, end: int) -> str:
    """The tokens with the gaps that their offsets leave."""
    raw, a, b = (sentence.get(k) for k in ("raw", "starts", "ends"))
    raw = raw or sentence["words"]
    if not a or not b:
        return " ".join(raw[start:end])
    return "".join((" " * max(0, a[i] - b[i - 1]) if i > start else "") + raw[i] for i in range(start, end))


def _plain(column: pa.Array) -> list:
    """column.to_pylist(), by whole columns of what arrays and structs hold, rather than by a value each."""
    kind, null = column.type, column.null_count
    if pa.types.is_list(kind):
        values, at, out = _plain(column.flatten()), 0, []
        for n in pc.list_value_length(column).to_pylist():
            out.append(None if n is None else values[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, r, strict=True)) for r in zip(*map(_plain, column.flatten()), strict=True)]
        return [r if v else None for r, v in zip(rows, column.is_valid().to_pylist(), strict=True)] if null else rows
    return column.to_numpy().tolist() if pa.types.is_integer(kind) and not null else column.to_pylist()


def extract(docs: DataFrame, grammar: str, keys: list[str], actions: dict[str, Action] | None = None, files: dict[str, str] | None = None, native: bool = True) -> DataFrame:
    """(keys, MENTION): the mentions of documents (keys, sentences), where sentences is an array of structs with the layers,
    and graphs, a map of edge arrays, if rules ask for them. The grammar is checked on the driver, before any task runs.

    A grammar without actions runs without Python workers (see nested.py), unless one of its rules needs the kernel or `native` is false.
    """
    from .nested import mentions

    rules = read_rules(grammar, files)
    if native and rules and not actions:
        try:
            return mentions(docs, keys, rules)
        except NotNative:
            pass
    shape = StructType([*docs.select(*keys).schema.fields, *StructType.fromDDL(MENTION).fields])
    kinds = to_arrow_schema(shape)

    # edges, of which there are as many as tokens, go to the workers only if a rule asks for them
    edges = any(r.kind in ("graph", "dependency") or re.search("incoming|outgoing", r.source) for r in rules)
    element = docs.schema["sentences"].dataType.elementType
    if not edges and isinstance(element, StructType) and "graphs" in element.names and len(element.names) > 1:
        kept = [n for n in element.names if n != "graphs"]
        docs = docs.withColumn("sentences", F.arrays_zip(*(F.col(f"sentences.{n}").alias(n) for n in kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = read_rules(grammar, files)
        for b in batches:
            for at in range(0, b.num_rows, 128):  # bounded memory
                part = b.slice(at, 128)
                rows = []
                ids = [part.column(k).to_pylist() for k in keys]
                for i, sentences in enumerate(_plain(part.column("sentences"))):
                    sentences = [s | {"graphs": dict(s["graphs"])} if s.get("graphs") else s for s in sentences or ()]
                    for m in extract_from(sentences, rules, actions):
                        args = [{"role": r, "mention_id": _id(x)} for r, xs in m.args for x in xs]
                        rows.append((*(k[i] for k in ids), _id(m), m.kind, list(m.labels), m.sent, m.start, m.end, text_of(sentences[m.sent], m.start, m.end), _id(m.trigger) if m.trigger else None, m.found_by, args))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return docs.select(*keys, "sentences").mapInArrow(run, shape)


def arguments(mentions: DataFrame, *keys: str) -> DataFrame:
    """(keys, mention_id, role, arg_id): a row an argument."""
    return mentions.select(*keys, "mention_id", F.explode("args").alias("a")).select(*keys, "mention_id", "a.role", F.col("a.mention_id").alias("arg_id"))


def describe(rules: list[Rule]) -> list[dict]:
    """Each rule's schema, for reports."""
    out = []
    for r in sorted(rules, key=lambda r: (r.labels, r.name)):
        roles = {a.name: a.label for a in r.pattern.arguments} if isinstance(r.pattern, GraphPattern) else {}
        program = [json.dumps([str(x) if not isinstance(x, str | int) else x for x in op]) for op in r.pattern.code] if isinstance(r.pattern, Program) else []
        out.append({"name": r.name, "labels": list(r.labels), "type": r.kind, "priority": f"{r.low}{'+' if r.high is None else f'-{r.high}'}", "keep": r.keep, "roles": roles, "program": program})
    return out


def markdown(rules: list[Rule]) -> str:
    """The rules by label, as a table in Markdown."""
    lines = ["| label | rule | type | priority | arguments |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {d['labels'][0]} | {d['name']} | {d['type']} | {d['priority']} | {', '.join(f'{k}: {v}' for k, v in d['roles'].items())} |" for d in describe(rules)]
    return "\n".join(lines)
