"""Connected classes of items that share keys, without expanding a key's items into pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop

#: Keys with three rows or more up to which they are broadcast, at 24 bytes each; beyond it, they are joined by a shuffle.
BROADCAST_KEYS = 200_000

#: Shared keys up to which they are broadcast, at 8 bytes each and some tens in the hash table; beyond it, they are joined by a shuffle.
BROADCAST_SHARED = 1_000_000

Verify = Callable[[DataFrame], DataFrame]
Linked = Callable[[Column, Column], Column]


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 signed words with a bit for each element of a set, by its hash."""
    out = np.zeros(bits, bool)
    out[(hashes >> np.uint64(40)) % np.uint64(bits)] = True
    return np.packbits(out, bitorder="little").view(np.int64)


def may_link(threshold: float, *bits: int) -> Linked:
    """A condition on two traits (bits, n) that all pairs of a Jaccard similarity of the threshold meet; bits: the sizes of bitmaps in use.

    The smaller set has the threshold's share of the larger one's elements at least. No two bitmaps of one size differ in more bits than the sets
    do in elements; a set of n elements can differ from one of m in (n + m)(1 - t)/(1 + t).
    """

    def test(a: Column, b: Column) -> Column:
        apart = F.lit(0)
        for n in bits:
            each = sum((F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(n // 64)), F.lit(0))
            apart = F.when((F.size(a["bits"]) == n // 64) & (F.size(b["bits"]) == n // 64), each).otherwise(apart)
        close = apart <= (1 - threshold) / (1 + threshold) * (a["n"] + b["n"]) + 1e-9
        return (F.least(a["n"], b["n"]) >= threshold * F.greatest(a["n"], b["n"]) - 1e-9) & close

    return test


def possible(pairs: DataFrame, traits: DataFrame, linked: Linked) -> DataFrame:
    """The pairs (a, b) whose traits meet the condition, already made."""
    of = lambda c, t: traits.select(F.col("id").alias(c), F.col("trait").alias(t))
    return cut(pairs.join(of("a", "_s"), "a").join(of("b", "_t"), "b").where(linked(F.col("_s"), F.col("_t"))).select("a", "b"))


def shared(keyed: DataFrame) -> DataFrame:
    """The distinct rows of (key, id) whose key another id has too, already made.

    Most keys are held by one id only, so the keys go first, combined before the shuffle, and only rows of shared ones follow.
    """
    keys = cut(keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"))
    asked = F.broadcast(keys) if keys.count() <= BROADCAST_SHARED else keys
    rows = cut(keyed.join(asked, "key", "left_semi").distinct())
    drop(keys)
    return rows


def spanning(pairs: DataFrame, held: Verify) -> DataFrame:
    """True links that join the same items as all true links among the distinct pairs (a, b); held: pairs to those that are links.

    Of each item one pair goes first, then those whose items are still apart.
    """
    pairs = cut(pairs)
    ends = pairs.select("a", "b", F.col("a").alias("x")).union(pairs.select("a", "b", F.col("b").alias("x")))
    once = cut(ends.groupBy("x").agg(F.min(F.struct(F.xxhash64("a", "b").alias("h"), "a", "b")).alias("p")).select("p.a", "p.b").distinct())
    links = cut(held(once))
    of = components(links)
    rest = pairs.join(once, ["a", "b"], "left_anti")
    rest = rest.join(of.select(F.col("id").alias("a"), F.col("component").alias("_x")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("component").alias("_y")), "b", "left")
    rest = cut(rest.where("coalesce(_x, a) <> coalesce(_y, b)").select("a", "b"))
    drop(pairs, once)
    return links.union(held(rest)) if rest.head(1) else links


def classes(keyed: DataFrame, verify: Verify | None = None, linked: Linked | None = None, traits: DataFrame | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, component) of all ids that a chain of true links joins; component is the smallest id.

    keyed: (key, id, home); rows that share a key and of which one at least is at home there are candidates.
    True links are the candidates that `linked`, a condition on both ids, holds for, or that verify, from pairs (a, b),
    returns. traits, (id, trait), lets `linked` hold two traits rather than ids, as a condition that every true link meets;
    it is then used where many pairs meet, before verify. The outcome is that of looking at every candidate pair, but pairs that can't change a class are left out:

    1. At a key of two rows, these two are held against each other; an aggregate of each key has them at hand.
       At the other keys, every row is held against one random item at home there. Each item meets as many
       such centres as it has keys, so large groups of similar items come together here, with one pair a row.
    2. At the keys where that leaves pairs out (two or more at home, three or more rows) and whose rows are still in
       more than one class, rows outside the key's largest class meet the rows of other classes.

    Neither step brings the rows of a key into one task: the centres come from aggregates that are combined
    before the shuffle, and the joins are plain equality joins, whose large keys adaptive execution splits.
    Rows of equal key and id should be few; they do no harm.
    """

    def met(a: DataFrame, b: DataFrame, x: str, y: str, also: Column | None = None) -> DataFrame:
        """True links between x of a and y of b at the same key."""
        on = (a["key"] == b["key"]) & (F.col(x) != F.col(y))
        on = on & also if also is not None else on
        on = on & linked(F.col(x), F.col(y)) if linked and traits is None else on
        return a.join(b, on).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def true(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        return cut(verify(pairs).select("a", "b") if verify else pairs)

    mask = F.xxhash64("key")  # ids in an order of the key's own; the least at home is the centre
    turned = F.col("id").bitwiseXOR(mask)
    shape = keyed.groupBy("key").agg(
        F.min(F.when(F.col("home"), turned)).alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.sum(F.when(F.col("home"), F.lit((1 << 32) + 1)).otherwise(F.lit(1))).alias("c"),
    )
    shape = cut(shape.where(f"c > {1 << 32} and lo < hi").select("key", "lo", "hi", F.col("m").bitwiseXOR(mask).alias("centre"), F.expr(f"c % {1 << 32}").alias("n"), F.expr(f"c div {1 << 32}").alias("homes")))
    two = shape.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    two = two.where(linked(F.col("a"), F.col("b"))) if linked and traits is None else two
    more = shape.where("n > 2").select("key", "centre", "homes")
    more = F.broadcast(more) if more.count() <= broadcast_keys else more
    links = true(two.union(met(keyed, more, "id", "centre")))
    joined = components(links)
    left_out = more.where("homes > 1").select("key")
    now = keyed.join(left_out, "key", "left_semi").join(joined, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    now = cut(now)
    share = now.groupBy("key", "class").agg(F.count("*").alias("n"))
    most = cut(share.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("most"), F.count("*").alias("k")).where("k > 1"))
    if traits is not None:  # only at keys that are still in several classes, as a row takes all keys of its item
        thin, now = now, now.join(most.select("key"), "key", "left_semi")
        now = cut(now.join(traits, "id").join(now.groupBy("id").agg(F.collect_set("key").alias("keys")), "id"))
        drop(thin)
    minor = now.join(most.select(F.col("key").alias("_k"), "most"), (F.col("key") == F.col("_k")) & (F.col("class") != F.col("most")))
    also = [F.col("trait").alias("xt"), F.col("keys").alias("xk")] if traits is not None else []
    minor = minor.select("key", "most", F.col("id").alias("x"), F.col("class").alias("xc"), F.col("home").alias("xh"), *also)
    # two rows that are both outside of the largest class meet once
    apart = (F.col("class") != F.col("xc")) & ((F.col("class") == F.col("most")) | (F.col("x") < F.col("id"))) & (F.col("home") | F.col("xh"))
    if traits is not None:  # and a pair meets at the first key that it shares
        apart = apart & linked(F.col("trait"), F.col("xt")) & (minor["key"] == F.array_min(F.array_intersect("keys", "xk")))
    last = true(met(minor, now, "x", "id", apart))
    out = components(links.union(last))
    drop(now, most, shape, last, links)
    return out
