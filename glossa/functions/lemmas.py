"""Lemmas by rules of endings: an approximation of a morphological analyser, in the JVM.

English: words of other letters than a to z, and bracket tokens, are their lower case. Irregular forms are a short list that callers may replace. A plural or third
person loses s, es or ies; a past or a participle loses ed or ing if a vowel comes before, and a doubled last consonant once. A final e isn't put back, except
after endings that English words don't have without it (at, iz, v, c, dg, rs, ns) and in short words like liked. Portuguese and Spanish, and any other language: lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IRREGULAR = {
    "am": "be", "are": "be", "been": "be", "being": "be", "is": "be", "was": "be", "were": "be", "did": "do", "does": "do", "done": "do", "had": "have", "has": "have",
    "went": "go", "gone": "go", "goes": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "saw": "see", "seen": "see", "got": "get",
    "gave": "give", "given": "give", "found": "find", "thought": "think", "told": "tell", "became": "become", "left": "leave", "felt": "feel", "brought": "bring",
    "began": "begin", "begun": "begin", "kept": "keep", "held": "hold", "wrote": "write", "written": "write", "stood": "stand", "ran": "run", "men": "man",
    "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse",
}

BRACKETS = "^-[lr][rs]b-$"
#: (pattern, replacement): the first that fits.
RULES = [
    ("^([a-z]+)sses$", "$1ss"),
    ("^([a-z]{2,})ies$", "$1y"),
    ("^([a-z]+)(sh|ch|x|zz)es$", "$1$2"),
    ("^([a-z]+(?:ss|us|is))$", "$1"),
    ("^([a-z]{2,})s$", "$1"),
    ("^([a-z]{2,})ied$", "$1y"),
    ("^([a-z]*[aeiouy][a-z]*?)(bb|dd|gg|mm|nn|pp|rr|tt)(?:ed|ing)$", "$1$2"),
    ("^([a-z]*[aeiouy][a-z]*|[a-z]*[aeiouy])(at|iz|v|c|dg|rs|ns)(?:ed|ing)$", "$1$2e"),
    ("^([bcdfghj-np-tvwxz]{1,2}[aiou]k)(?:ed|ing)$", "$1e"),
    ("^([a-z]*[aeiouy][a-z]+)(?:ed|ing)$", "$1"),
]


def lemma(word: Column, lang: str = "en", irregular: dict[str, str] = IRREGULAR) -> Column:
    """The lemma of a word; null for null. A word that is nothing but marks is itself, in lower case."""
    low = F.lower(word)
    if lang != "en":
        return low
    bare = F.trim(F.regexp_replace(F.trim(low), r"[()\[\].,;:\"']", ""))
    known = F.create_map(*(F.lit(x) for pair in irregular.items() for x in pair)) if irregular else None
    by_rule = F.when(F.lit(False), bare)
    for pattern, to in RULES:
        made = F.regexp_replace(bare, pattern, to)
        if "bb|dd" in pattern:
            made = F.substring(made, F.lit(1), F.length(made) - 1)
        by_rule = by_rule.when(bare.rlike(pattern), made)
    found = F.coalesce(F.try_element_at(known, bare), by_rule, bare) if irregular else F.coalesce(by_rule, bare)
    return F.when(word.isNull(), F.lit(None).cast("string")).when(low.rlike(BRACKETS) | (bare == ""), low).otherwise(found)


def with_lemmas(sentences: Column, lang: str = "en") -> Column:
    """Sentences whose lemmas, where nobody filled them, are those of their words."""
    return F.transform(sentences, lambda s: s.withField("lemmas", F.coalesce(s["lemmas"], F.transform(s["words"], lambda w: lemma(w, lang)))))
