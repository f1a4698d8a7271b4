"""Entities of open information extraction: noun phrases from rules, grown along edges, cut and filtered.

One Arrow pass over documents (keys, sentences); finders never look beyond a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glossa.plans.rules import DEFAULT_GRAPH, Mention, State, View, extract_from, read_rules

# Tags of the Penn treebank that play a part, and edges that an entity grows along.
NOUN, ADJECTIVE, COORDINATING = re.compile("^NN"), re.compile("^JJ"), re.compile("^(CC|,|-LRB-|-RRB-)$")
FINAL = re.compile("^(NN|CD|FW|-RRB-)")
GROWS = re.compile("^(amod|advmod|compound|nn|num|nummod|nmod_of|prep_of|dobj|name|flat)")
STAYS_OUT = re.compile("^(acl:relcl|advcl|conj|cc|nsubj|punct)")
STOP_ENTITIES = frozenset("DATE DURATION MONEY NUMBER ORDINAL PERCENT SET TIME".split())
BASE = '[{name: np, label: Entity, type: token, priority: 1, pattern: "[tag=/^JJ/]* [tag=/^NN/]+"}]'


def grown(view: View, start: int, end: int, avoid: set[int], hops: int) -> tuple[int, int]:
    """The span from the first to the last token that edges reach from [start, end)."""
    seen, front = set(range(start, end)), list(range(start, end))
    for _ in range(hops):
        ahead = [o for t in front for o, r in view.edges(t, False) if GROWS.search(r) and not STAYS_OUT.search(r) and o not in seen and o not in avoid]
        seen.update(ahead)
        front = ahead
    low, high = min(seen), max(seen) + 1
    return (low, high) if not avoid & set(range(low, high)) else (start, end)


def parts(tags: list[str], start: int, end: int) -> list[tuple[int, int]]:
    """A span cut at coordinating tags, unless an adjective comes before, as in `old and new`."""
    out, at = [], start
    for i in range(start, end):
        if COORDINATING.match(tags[i]) and not (i > start and ADJECTIVE.match(tags[i - 1])):
            out.append((at, i))
            at = i + 1
    return [(a, b) for a, b in [*out, (at, end)] if b > a]


def fit(layers: dict, start: int, end: int, longest: int, stop: frozenset = frozenset()) -> bool:
    """A noun and a word of content inside, a final tag at the end, brackets that match, and no more than `longest` tokens."""
    tags, words = layers["tags"][start:end], layers["words"][start:end]
    if end - start > longest or not FINAL.match(tags[-1]) or words.count("(") != words.count(")"):
        return False
    entities = (layers.get("entities") or ["O"] * len(layers["words"]))[start:end]
    lemmas = (layers.get("lemmas") or layers["words"])[start:end]
    content = any(len(le) > 1 and le.lower() not in stop and e.removeprefix("B-").removeprefix("I-") not in STOP_ENTITIES for le, e in zip(lemmas, entities, strict=True))
    return content and any(NOUN.match(t) for t in tags)


def find_entities(sentences: list[dict], grammar: str = BASE, avoid: str | None = None, hops: int = 5, longest: int = 10, stop: frozenset = frozenset()) -> list[tuple[int, int, int]]:
    """(sentence, start, end) of entities; of overlapping ones the longest, then the first. avoid: a grammar of what may not be touched."""
    seeds: list[Mention] = extract_from(sentences, read_rules(avoid)) if avoid else []
    rules = read_rules(grammar)
    names = {r.name for r in rules}
    found = [m for m in extract_from(sentences, rules, seeds=seeds) if m.found_by in names]
    state, out = State(), set()
    taboo = {(m.sent, i) for m in seeds for i in range(m.start, m.end)}
    views = [View(s, i, state, DEFAULT_GRAPH) for i, s in enumerate(sentences)]
    for m in found:
        here = {i for s, i in taboo if s == m.sent}
        if here & set(range(m.start, m.end)):
            continue
        a, b = grown(views[m.sent], m.start, m.end, here, hops)
        out |= {(m.sent, x, y) for x, y in parts(sentences[m.sent]["tags"], a, b) if fit(sentences[m.sent], x, y, longest, stop)}
    kept: list[tuple[int, int, int]] = []
    for s, a, b in sorted(out, key=lambda e: (e[0], e[1] - e[2], e[1])):
        if not any(s == t and a < y and x < b for t, x, y in kept):
            kept.append((s, a, b))
    return sorted(kept)


def entities(docs: DataFrame, keys: list[str], **options) -> DataFrame:
    """(keys, sent, start, end) of the entities of documents (keys, sentences)."""
    shape = StructType([*docs.select(*keys).schema.fields, *StructType.fromDDL("sent int, start int, end int").fields])
    kinds = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b.column(k).to_pylist() for k in keys]
            rows = []
            for i, sentences in enumerate(b.column("sentences").to_pylist()):
                sentences = [s | {"graphs": dict(s["graphs"])} if s.get("graphs") else s for s in sentences or ()]
                rows += [(*(k[i] for k in ids), *e) for e in find_entities(sentences, **options)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return docs.select(*keys, "sentences").mapInArrow(run, shape)
