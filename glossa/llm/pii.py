"""Personal data replaced by surrogates: keyed, consistent in type and format, and the same for the same entity everywhere.

Found are e-mail addresses, phone and card numbers, IPv4 addresses, IBANs, social security numbers, long hexadecimal
secrets, names after a title, and in the same text every further mention of a part of such a name, with a title or without. Ordinary words are left alone: a word
that stands in lower case in the table at one in ORDINARY of its places or more often is a name only straight after a title, so neither "The" of "Mr Smith The next day"
nor, elsewhere, the colour of Mr Brown is replaced. A surrogate is drawn from a keyed
hash (SHA-512 over key, type, attempt and the normalised entity): each digit becomes a digit, each letter one of its script and case, hexadecimal stays
hexadecimal, an IP address becomes a valid one, a card number with a right check digit gets one; separators stay. Given names keep the title's gender by
their ending, after titles of no gender they have an ending of their own; names in Cyrillic or Greek letters keep their script, others are Latin; letters of
addresses and numbers stay in their script where LETTERS has it, and become Latin ones otherwise. So a mention of the same entity gets the same surrogate in any document, however it is written.

Collision checks keep distinct entities distinct: over all entities of the table, a surrogate that two
entities would share, or that is an entity of the table itself, is drawn anew (attempt 1, 2, ...) until none is left; names grow longer with each
attempt, and only if a format has no room for its entities there is an error. The few
redrawn entities, and the ordinary words in names, are looked up while replacing: as a literal while they are at most LITERAL_ROWS, else by a join.
Both depend on the table, so tables that must agree have to be replaced together.

The key is GLOSSA_PII_KEY in the driver's environment; without it, each call draws a random key of its own. It is part of the plan, so plans are as secret as the key.

Defined results: a null text stays null and a text without entities stays as it is; texts of any length are searched whole; repeated rows are
replaced alike; an empty table gives an empty result; other columns stay, whatever their names, but for `_entities`, which is replaced.
DataFrame and SQL functions only.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

#: Redrawn entities, or ordinary words, up to which they are a literal in the plan; beyond it, they are joined.
LITERAL_ROWS = 2000
#: Words of names up to which they are broadcast; beyond it, all words are counted before they are joined.
BROADCAST_WORDS = 100_000
#: A word is ordinary if one in so many of its places has it in lower case.
ORDINARY = 10
#: Attempts in a row that settle nothing, after which a format counts as full.
FRUITLESS = 20
MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|Господин|Κύριος|Κος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Госпожа|Κυρία|Κα"
NEUTRAL = "Dr|Prof|Professor|Doctor|Доктор|Профессор|Δρ"
TITLE = f"(?:{MALE}|{FEMALE}|{NEUTRAL})\\.? "
EDGE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GAP = r"[^\p{L}\p{N}]{1,6}"
NAME = rf"(?!{TITLE}\p{{Lu}})\p{{Lu}}[\p{{L}}\x27’-]*+"
WORD = r"\p{L}[\p{L}\x27’-]*+"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}{END}(?!\.[0-9])"
NAMED = rf"{EDGE}{TITLE}{NAME}(?: {NAME})?"
PATTERN = "|".join((
    EMAIL,
    rf"{EDGE}[0-9a-fA-F]{{32,}}+{END}",
    rf"{EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{END}",
    IP,
    rf"{EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{END}",
    rf"{EDGE}(?:[0-9]{{4}}[ -]){{3}}[0-9]{{4}}{END}",
    rf"{EDGE}[0-9]{{13,19}}{END}",
    rf"\+[0-9]{{1,3}}{GAP}[0-9]{{2,4}}{GAP}[0-9]{{3,4}}{GAP}[0-9]{{3,4}}{END}",
    rf"\([0-9]{{3}}\)[^\p{{L}}\p{{N}}]{{0,6}}[0-9]{{3}}{GAP}[0-9]{{4}}{END}",
    rf"{EDGE}\+?[0-9]{{0,2}}[0-9]{{3}}[-. ][0-9]{{3}}[-. ][0-9]{{4}}{END}",
    rf"\+[0-9]{{10,15}}{END}",
    NAMED,
))
#: A text without any of these has no entity.
NAME_HINT = rf"{TITLE}\p{{Lu}}"
HINT = rf"[0-9@]|[a-fA-F]{{32}}|{NAME_HINT}"

#: The type of the match {e}, and the normal form of an entity {v} of type {t}, as SQL.
TYPE = (
    f"case when {{e}} like '%@%' then 'email' when {{e}} rlike r'^(?:{MALE})\\.? ' then 'man_name' when {{e}} rlike r'^(?:{FEMALE})\\.? ' then 'woman_name' when {{e}} rlike r'^(?:{NEUTRAL})\\.? ' then 'given_name'"
    f" when {{e}} rlike r'^(?:{OCTET}\\.){{{{3}}}}{OCTET}$' then 'ip' when {{e}} rlike '^[0-9a-fA-F]{{{{32,}}}}$' then 'hex' when {{e}} rlike '^[A-Z]' then 'iban'"
    " when {e} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn' when {e} rlike '^[0-9]{{13,19}}$|^[0-9]{{4}}[ -][0-9]{{4}}[ -]' then 'card' else 'phone' end"
)
NORM = r"if({t} in ('email', 'ip') or {t} like '%name', lower({v}), lower(regexp_replace({v}, r'[^\p{{L}}\p{{N}}]', '')))"
LETTERS = {
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{IsHan}": "安白丁方高何江林明文学德华英海春东云天平",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsDevanagari}": "अइउएकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    r"\p{IsArmenian}": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ", r"\p{IsGeorgian}": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", r"\p{IsThai}": "กขคฆงจฉชซญฎฏฐณดตถทธนบปผฝพฟภมยรลวศษสหอฮ",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호",
}
SYLLABLES = {r"\p{IsCyrillic}": "ба,ве,го,ди,жа,зе,ки,ло,ма,не,по,ри,са,те,фи,ху", r"\p{IsGreek}": "βα,γε,δι,ζο,θε,κα,λυ,μα,νι,πο,ρα,σε,τι,φω,χα,ψε", "": "ba,ce,do,fi,ga,he,jo,ka,le,mi,no,pa,re,si,to,vu"}
ENDINGS = {r"\p{IsCyrillic}": {"man_name": "н,р,с,й", "woman_name": "на,ра,са,ля", "given_name": "ш,ж,чи,гу", "surname": "ко,дзе,чук,нер"}, r"\p{IsGreek}": {"man_name": "ς,νος,ρης,λας", "woman_name": "να,ρα,λια,τη", "given_name": "ξ,ψ,ρι,μω", "surname": "δης,πουλος,κος,ιδης"}, "": {"man_name": "n,rd,s,lf", "woman_name": "na,ra,lia,tta", "given_name": "m,x,ri,wyn", "surname": "ster,mann,ley,nder"}}


def _quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _byte(i: str) -> str:
    return f"cast(conv(substr(h, 1 + 2 * (({i}) % 64), 2), 16, 10) as int)"


def _pick(options: str, at: str) -> str:
    n = len(options.split(","))
    return f"split('{options}', ',')[{at} % {n}]"


def _luhn(digits: str) -> str:
    doubled = "if(i % 2 = 1, if(2 * int(d) > 9, 2 * int(d) - 9, 2 * int(d)), int(d))"
    return f"(aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (d, i) -> {doubled}), 0, (s, x) -> s + x) % 10)"


def _drawn(key: str, t: str, v: str, n: str, a: str) -> str:
    """The surrogate of the entity v, of type t and normal form n, at attempt a, as SQL."""
    b = _byte("acc.i")
    letter = f"substr('abcdefghijklmnopqrstuvwxyz', {b} % 26 + 1, 1)"
    other = letter
    for script, alphabet in LETTERS.items():
        other = f"if(c rlike r'{script}', substr('{alphabet}', {b} % {len(alphabet)} + 1, 1), {other})"
    letter = f"if(c < '\u0250', {letter}, {other})"  # Latin ones end there
    hexed = f"substr('0123456789abcdef', {b} % 16 + 1, 1)"
    new = (
        f"case when acc.stop then c when {t} = 'hex' then if({v} = upper({v}), upper({hexed}), {hexed}) when c rlike '[0-9]' then string({b} % 10)"
        f" when c rlike r'\\p{{Lu}}' then upper({letter}) when c rlike r'[\\p{{L}}\\p{{N}}]' then {letter} else c end"
    )
    walk = (
        f"aggregate(filter(split({v}, ''), x -> x <> ''), named_struct('o', '', 'i', 0, 'at', false, 'stop', false),"
        f" (acc, c) -> named_struct('o', concat(acc.o, {new}), 'i', acc.i + int(c rlike r'[\\p{{L}}\\p{{N}}]'), 'at', acc.at or c = '@',"
        f" 'stop', acc.stop or ({t} = 'email' and acc.at and c = '.')), acc -> acc.o)"
    )
    ip = f"concat_ws('.', string(1 + {_byte('0')} % 223), string({_byte('1')}), string({_byte('2')}), string(1 + {_byte('3')} % 254))"
    name = "''"
    for script, syllables in list(SYLLABLES.items())[::-1]:
        ends = " ".join(f"when '{kind}' then {_pick(x, _byte('4'))}" for kind, x in ENDINGS[script].items())
        more = f"if({a} > 0, array_join(transform(sequence(1, cast({a} as int)), i -> {_pick(syllables, _byte('4 + i'))}), ''), '')"
        made = f"initcap(concat({', '.join(_pick(syllables, _byte(str(i))) for i in range(3))}, {more}, case {t} {ends} end))"
        name = f"if({v} rlike r'{script}', {made}, {name})" if script else made
    name = f"if({v} = upper({v}) and length({v}) > 1, upper({name}), {name})"
    body = "regexp_replace(substr(w, 1, length(w) - 1), '[ -]', '')"
    checked = f"concat(substr(w, 1, length(w) - 1), string((10 - {_luhn(f'concat({body}, 0)')}) % 10))"
    card = f"if({_luhn(f'regexp_replace({v}, r"[ -]", r"")')} = 0, transform(array({walk}), w -> {checked})[0], {walk})".replace('"', "'")
    return (
        f"transform(array(sha2(concat_ws('|', {_quoted(key)}, {t}, string({a}), {n}), 512)), h ->"
        f" case when {t} = 'ip' then {ip} when {t} like '%name' then {name} when {t} = 'card' then {card} else {walk} end)[0]"
    )


def _title(e: str) -> str:
    return f"if({e} rlike r'^{TITLE}', regexp_extract({e}, '^([^ ]+ )', 1), '')"


def _parts(e: str) -> str:
    """The words of the match e after its title."""
    return f"split(substr({e}, length({_title(e)}) + 1), ' ')"


def _is_ordinary(w: str) -> str:
    return f"array_contains(_ordinary, lower({w}))"


def _rest(e: str) -> str:
    """What follows the name in the match e: a second word that is none."""
    return f"if({_title(e)} = '', '', array_join(transform(filter({_parts(e)}, (w, i) -> i > 0 and {_is_ordinary('w')}), w -> concat(' ', w)), ''))"


def _entities(e: str) -> str:
    """The match e as an array of entities (t, n, v): a name's parts are entities of their own, ordinary words but the first aren't."""
    words = f"filter({_parts(e)}, (w, i) -> i = 0 or not {_is_ordinary('w')})"
    t = TYPE.format(e=e)
    made = lambda t, v: f"named_struct('t', {t}, 'n', {NORM.format(t=t, v=v)}, 'v', {v})"
    part = f"transform({words}, (w, i) -> transform(array(if(i = 0 and size({words}) > 1, k, 'surname')), p -> {made('p', 'w')})[0])"
    return f"flatten(transform(array({t}), k -> if(k like '%name', {part}, array({made('k', e)}))))"


def _mentions(e: str, names: str) -> str:
    """Like _entities, for a match that may be a part of a name that `names`, entities of the same text, holds."""
    same = f"filter({names}, x -> x.n = lower({e}))"
    return f"if(size({same}) > 0, array(named_struct('t', {same}[0].t, 'n', lower({e}), 'v', {e})), {_entities(e)})"


def matches(text: str) -> Column:
    """The matches in a text; texts without a hint aren't searched."""
    return F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _name_words(text: str) -> Column:
    """The words of the names in a text, in lower case."""
    words = f"transform(flatten(transform(regexp_extract_all({text}, {_quoted(NAMED)}, 0), e -> {_parts('e')})), w -> lower(w))"
    return F.when(F.col(text).rlike(NAME_HINT), F.expr(words)).otherwise(F.array().cast("array<string>"))


def ordinary(docs: DataFrame, text: str) -> DataFrame:
    """(w): the words of the table's names that are ordinary words too, in lower case."""
    asked = cut(docs.select(F.explode(_name_words(text)).alias("w")).distinct())
    n = asked.count()
    if not n:
        return asked
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("v")).select(F.lower("v").alias("w"), F.expr("int(v = lower(v))").alias("low"))
    if n <= BROADCAST_WORDS:
        words = words.join(F.broadcast(asked), "w", "left_semi")
    counts = words.groupBy("w").agg(F.sum("low").alias("low"), F.count("*").alias("n")).where(f"low > 0 and low * {ORDINARY} >= n").select("w")
    found = cut(counts if n <= BROADCAST_WORDS else counts.join(asked, "w", "left_semi"))
    drop(asked)
    return found


def _with_ordinary(held: DataFrame) -> DataFrame:
    """held with _ordinary: of the table's ordinary words those that the names in _text need."""
    found = ordinary(held, "_text")
    n = found.count()
    if n <= LITERAL_ROWS:
        out = held.withColumn("_ordinary", F.array(*(F.lit(r["w"]) for r in found.collect())).cast("array<string>"))
        drop(found)
        return out
    marked = held.withColumn("_row", F.xxhash64("_text"))
    asked = marked.select("_row", F.explode(_name_words("_text")).alias("w")).distinct().join(found, "w")
    of = asked.groupBy("_row").agg(F.collect_set("w").alias("_some"))
    empty = F.array().cast("array<string>")
    return marked.join(of, "_row", "left").select(*held.columns, F.coalesce("_some", empty).alias("_ordinary"))


def redrawn(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, attempt) of the entities whose first surrogates would collide; id is 'type|normal form'."""
    return _redrawn(_with_ordinary(docs.select(F.col(text).alias("_text"))), key)


def _redrawn(held: DataFrame, key: str) -> DataFrame:
    drawn = lambda a: F.expr(_drawn(key, "t", "n", "n", a))
    normal = lambda c: F.expr(NORM.format(t="t", v=c))
    found = held.select("_ordinary", F.explode(matches("_text")).alias("e")).select(F.inline(F.expr(_entities("e")))).select("t", "n").distinct()
    real = cut(found.withColumn("s", drawn("0")).withColumn("s", normal("s")))
    own = real.select("t", F.col("n").alias("s"))

    def colliding(new: DataFrame, old: DataFrame | None) -> DataFrame:
        """(t, n) of new that may not have their surrogate: it is an entity, or another's surrogate."""
        first = new.groupBy("t", "s").agg(F.min("n").alias("first"), F.count("*").alias("k")).where("k > 1")
        bad = new.join(own, ["t", "s"], "left_semi").select("t", "n").union(new.join(first, ["t", "s"]).where("n <> first").select("t", "n"))
        if old is not None:
            bad = bad.union(new.join(old.select("t", "s"), ["t", "s"], "left_semi").select("t", "n"))
        return bad.distinct()

    wrong = cut(colliding(real, None))
    kept, out, attempt, fruitless, left = real, None, 0, 0, wrong.count()
    while left:
        attempt += 1
        settled = kept.join(wrong, ["t", "n"], "left_anti") if out is None else kept
        new = cut(wrong.withColumn("s", drawn(str(attempt))).withColumn("s", normal("s")))
        wrong = cut(colliding(new, settled))
        done = new.join(wrong, ["t", "n"], "left_anti")
        kept = cut(settled.union(done))
        row = done.select(F.concat_ws("|", "t", "n").alias("id"), F.lit(attempt).alias("attempt"))
        out = row if out is None else out.union(row)
        before, left = left, wrong.count()
        fruitless = fruitless + 1 if left == before else 0
        if fruitless == FRUITLESS:
            raise RuntimeError("surrogates: more entities than their formats have room for")
    found = cut(out) if out is not None else held.sparkSession.createDataFrame([], "id string, attempt int")
    drop(real)
    return found


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the entities of the text replaced, and _entities, their number."""
    names = [c for c in docs.columns if c != "_entities"]
    held = docs.select(F.struct(*names).alias("_doc"), F.col(text).alias("_text"))  # so no column's name can clash
    held = _with_ordinary(held)
    again = _redrawn(held, key)
    attempt, n = "0", again.count()
    if 0 < n <= LITERAL_ROWS:
        pairs = ", ".join(f"{_quoted(r['id'])}, {r['attempt']}" for r in again.collect())
        attempt = f"coalesce(element_at(map({pairs}), concat_ws('|', x.t, x.n)), 0)"
    elif n:
        marked = held.withColumn("_row", F.xxhash64("_text"))
        asked = marked.select("_row", "_ordinary", F.explode(matches("_text")).alias("e")).select("_row", F.inline(F.expr(_entities("e"))))
        asked = asked.select("_row", F.concat_ws("|", "t", "n").alias("id")).distinct().join(again, "id")
        of = asked.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("id", "attempt"))).alias("_map"))
        held = marked.join(of, "_row", "left")
        attempt = "coalesce(element_at(_map, concat_ws('|', x.t, x.n)), 0)"
    held = held.withColumn("_first", matches("_text"))
    held = held.withColumn("_names", F.expr(f"filter(flatten(transform(_first, e -> {_entities('e')})), x -> x.t like '%name')"))
    bare = r"concat('\\Q', x, '\\E')"  # NAME allows no backslash
    parts = f"array_join(transform(array_distinct(flatten(transform(filter(_names, x -> length(x.v) > 1 and not {_is_ordinary('x.v')}), x -> array(x.v, upper(x.v))))), x -> {bare}), '|')"
    held = held.withColumn("_parts", F.expr(parts))
    # in texts with names, their parts are found too, wherever they stand
    wide = F.concat(F.lit(f"{PATTERN}|{EDGE}(?:"), F.col("_parts"), F.lit(f"){END}"))
    named = F.col("_parts") != ""
    held = held.withColumn("_found", F.when(named, F.regexp_extract_all("_text", wide, F.lit(0))).otherwise(F.col("_first")))
    new = f"concat({_title('e')}, array_join(transform({_mentions('e', '_names')}, x -> {_drawn(key, 'x.t', 'x.v', 'x.n', attempt)}), ' '), {_rest('e')})"
    held = held.withColumn("_new", F.expr(f"transform(_found, e -> {new})"))
    between = F.when(named, F.split(F.col("_text"), wide, -1)).otherwise(F.split(F.col("_text"), PATTERN, -1))
    joined = F.array_join(F.flatten(F.zip_with(between, F.col("_new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    replaced = F.when(F.size("_found") > 0, joined).otherwise(F.col("_text"))
    return held.select(*((replaced if c == text else F.col("_doc").getField(c)).alias(c) for c in names), F.size("_found").alias("_entities"))


def secret() -> str:
    """The key of the surrogates: GLOSSA_PII_KEY, or a random one."""
    return os.environ.get("GLOSSA_PII_KEY") or secrets.token_hex(32)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret())
    return found.select("doc_id", "text", F.col("_entities").cast("long").alias("n_entities"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in their texts; n_chars follows the text."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text", "n_chars")  # so no column's name can clash
    found = pseudonymise(whole, secret())
    size = F.when(F.col("_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("text"), "n_chars": size}
    return found.select(*(new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns))
