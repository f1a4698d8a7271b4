"""Mixing sources to target weights with Pfair scheduling.

A slot takes one block of rows of one source. Block i of a source whose share of the slots is w may not come before its release floor(i / w) and
must come before its deadline ceil((i + 1) / w). Of the blocks released, the one with the earliest deadline takes the slot (ties to the source
that sorts first); as the shares sum to 1, every deadline is met, and at any slot each source has had its share of the slots to within less than one block.

Shares are whole numbers out of about UNITS = 2^30, so that rounding moves no source by a block over as many slots; mix() refuses more slots than that, and
larger blocks make fewer. Up to PERIOD slots are one row, whose order is worked out slot by slot. More are cut into periods of PERIOD slots, a row each, that are dealt out over
tasks: at a period's first slot each source has had its share rounded down or up to whole blocks, those with the earliest deadlines up, and a source
once up stays so until its share gets there (by induction there are always as many to round up as are up already). Within a period, windows follow from these whole numbers, so
that the order stays less than a block from the straight line between its ends, and less than two from the targets. No source's rows
meet in one task either: rows are numbered within cells of a hash, and cells by their counts.

With `quanta`, weights are rounded to about that many whole quanta instead, one at least, and the order of one period of them repeats.

A source that ends leaves its later slots empty; the others keep their order and their proportions among each other. No row is dropped or repeated.

Defined results: a null source is a source; rows of a source whose weight is missing, null, zero or negative have no slot (null), as its share is none (with `quanta`, it
gets one quantum); rows with equal ids are interchangeable; null ids have a place; null and long texts don't matter; an empty table gives an empty
result; columns of docs that are named like those of the result are replaced.
DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, hex_digits_for, number_rows, table

#: Slots of a period up to which its order is broadcast, at about 30 bytes a slot; beyond it, it is joined by a shuffle.
BROADCAST_SLOTS = 100_000
UNITS, PERIOD = 1 << 30, 1 << 16


def with_quanta(weights: DataFrame, quanta: int) -> DataFrame:
    """One row with s, the sorted array of (source, q): about `quanta` in all, one at least each; none if there are no sources."""
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double")
    row = weights.agg(F.array_sort(F.collect_list(F.struct("source", w.alias("w")))).alias("s")).where("size(s) > 0")
    row = row.withColumn("total", F.expr("aggregate(s, 0.0D, (a, x) -> a + x.w)"))
    share = f"if(total > 0, greatest(1, cast(floor({quanta} * x.w / total + 0.5) as int)), 1)"
    return row.select(F.expr(f"transform(s, x -> struct(x.source as source, {share} as q))").alias("s"))


def period(row: DataFrame) -> DataFrame:
    """(source, q, period, k, slot): the slot that the kth block of each source takes in a period; row: with_quanta()."""
    row = row.withColumn("p", F.expr("aggregate(s, 0, (a, x) -> a + x.q)"))
    picked = F.expr("""
      aggregate(sequence(0, p - 1), struct(transform(s, x -> 0) as taken, cast(array() as array<int>) as picks),
        (acc, t) -> transform(
          array(array_min(transform(s, (x, i) -> if(
            acc.taken[i] < x.q and (acc.taken[i] * cast(p as bigint)) div x.q <= t,
            struct(((acc.taken[i] + 1) * cast(p as bigint) + x.q - 1) div x.q as deadline, i as i), null)))),
          best -> struct(transform(acc.taken, (n, i) -> if(i = best.i, n + 1, n)) as taken, array_append(acc.picks, best.i) as picks))[0],
        acc -> acc.picks)""")
    slots = row.select("s", "p", F.posexplode(picked).alias("slot", "i"))
    nth = Window.partitionBy("i").orderBy("slot")
    return slots.select(F.expr("s[i].source").alias("source"), F.expr("s[i].q").alias("q"), F.col("p").alias("period"), (F.row_number().over(nth) - 1).cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


#: Blocks that each source of s has had before the slot m * size: acc.c are those before the slot (m - 1) * size.
_ROUNDED = """
  transform(array(transform(s, x -> (m * size * x.q) div w)),
    low -> transform(array(transform(
        slice(array_sort(filter(transform(s, (x, i) -> struct(if(acc.c[i] > low[i], 0, 1) as up, ((low[i] + 1) * w + x.q - 1) div x.q as deadline, i as i, (m * size * x.q) % w as rest)), y -> y.rest > 0)),
          1, cast(m * size - aggregate(low, 0L, (a, n) -> a + n) as int)),
        y -> y.i)),
      ups -> transform(low, (n, i) -> n + if(array_contains(ups, i), 1L, 0L)))[0])[0]"""
#: The order of one row: (i, k) for each slot, i = -1 where none is due. Slots go by 256, as appending copies.
_PICKED = """
  flatten(aggregate(sequence(0L, (n - 1) div 256), struct(transform(s, x -> 0L) as taken, cast(array() as array<array<struct<i: int, k: bigint>>>) as picks),
    (all, c) -> transform(array(
      aggregate(sequence(c * 256, least(n, c * 256 + 256) - 1), struct(all.taken as taken, cast(array() as array<struct<i: int, k: bigint>>) as picks),
        (acc, t) -> transform(
          array(array_min(transform(s, (x, i) -> if(acc.taken[i] < x.most and (acc.taken[i] * w) div x.q <= t,
            struct(((acc.taken[i] + 1) * w + x.q - 1) div x.q as deadline, i as i), null)))),
          best -> struct(transform(acc.taken, (k, i) -> if(i <=> best.i, k + 1, k)) as taken,
            array_append(acc.picks, struct(coalesce(best.i, -1) as i, coalesce(acc.taken[best.i], -1L) as k)) as picks))[0])),
      done -> struct(done.taken as taken, array_append(all.picks, done.picks) as picks))[0],
    all -> all.picks))"""


def schedule(known: DataFrame, sizes: DataFrame, block_rows: int, size: int = PERIOD) -> DataFrame:
    """(source, q, period, k, slot): the slot of the kth block of each source that has a weight, over all its blocks; q / period is its share.

    known: (source, weight), sizes: (source, rows); size: the slots of a row.
    """
    both = known.where("weight > 0").join(sizes.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    row = both.agg(F.sum("weight").alias("total"), F.collect_list(F.struct("source", F.col("weight").cast("double").alias("weight"), F.expr(f"(rows + {block_rows - 1}) div {block_rows}").alias("blocks"))).alias("s"))
    share = f"greatest(1L, cast(floor({UNITS} * x.weight / total + 0.5) as bigint))"
    row = row.where("size(s) > 0").select(F.expr(f"array_sort(transform(s, x -> struct(x.source as source, {share} as q, x.blocks as blocks)))").alias("s"), F.lit(size).cast("long").alias("size"))
    row = row.withColumn("w", F.expr("aggregate(s, 0L, (a, x) -> a + x.q)"))
    row = row.withColumn("slots", F.expr("array_max(transform(s, x -> cast(ceil(x.blocks / x.q * w) as bigint) + 1))"))
    row = row.withColumn("slots", F.expr(f"if(slots <= {UNITS}, slots, cast(raise_error('mixing takes over {UNITS} slots; take larger blocks') as bigint))"))
    one = row.where("slots <= size").select("w", F.lit(0).cast("long").alias("t"), F.col("slots").alias("n"), F.expr("transform(s, x -> struct(x.source as source, x.q as q, 0L as first, x.blocks as most, x.q as share))").alias("s"), F.col("w").alias("period"))
    ends = F.expr(f"""aggregate(sequence(1L, (slots - 1) div size + 1), struct(transform(s, x -> 0L) as c, array(transform(s, x -> 0L)) as all),
      (acc, m) -> transform(array({_ROUNDED}), c -> struct(c as c, array_append(acc.all, c) as all))[0], acc -> acc.all)""")
    cuts = row.where("slots > size").withColumn("ends", ends).select("s", "w", "size", "ends", F.explode(F.expr("sequence(0, size(ends) - 2)")).alias("m"))
    cuts = cuts.select("w", "size", "m", "s", F.expr("ends[m]").alias("c0"), F.expr("ends[m + 1]").alias("c1")).repartition("m")
    of = "filter(transform(s, (x, i) -> struct(x.source as source, c1[i] - c0[i] as q, c0[i] as first, least(c1[i], x.blocks) - c0[i] as most, x.q as share)), x -> x.most > 0)"
    cuts = cuts.select(F.col("size").alias("w"), F.expr("m * size").alias("t"), F.col("size").alias("n"), F.expr(of).alias("s"), F.col("w").alias("period"))
    slots = one.union(cuts).where("size(s) > 0").select("s", "t", "period", F.posexplode(F.expr(_PICKED)).alias("j", "p")).where("p.i >= 0")
    return slots.select(F.expr("s[p.i].source").alias("source"), F.expr("s[p.i].share").alias("q"), "period", F.expr("s[p.i].first + p.k").alias("k"), (F.col("t") + F.col("j")).alias("slot"))


def tempered(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """(source, weight): each source's rows to a power, which lifts small sources."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def order_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


MIXED = ("q", "period", "block", "slot", "release", "deadline", "place")


def mix(docs: DataFrame, weights: DataFrame, block_rows: int = 16, quanta: int | None = None) -> DataFrame:
    """docs with q, period, block, slot, release, deadline and place: (slot, place) is the mixed order.

    Within a source, rows come in the order of a hash of their ids. weights: (source, weight). quanta: None takes the weights as they are; a number
    rounds them to about so many in all, one at least for each source.
    """
    keep = [c for c in docs.columns if c not in MIXED]
    docs = docs.select(F.struct(*keep).alias("_doc"), "doc_id", "source")  # so no column's name can clash
    sizes = cut(docs.groupBy("source").agg(F.count("*").alias("rows")))
    given = weights.where("weight is not null").groupBy(F.col("source").alias("_s")).agg(F.max("weight").alias("weight"))
    known = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "weight")
    once = cut(period(with_quanta(known, quanta)) if quanta else schedule(known, sizes, block_rows))
    slots = once.count()
    digits = hex_digits_for(sizes.agg(F.sum("rows")).first()[0] or 0, 2000)
    drop(sizes)
    keyed = docs.withColumn("_h", order_key()).withColumn("_cell", F.substring("_h", 1, digits))
    numbered = number_rows(keyed, "source", "_cell", ["_h"], "_n").withColumn("block", F.expr(f"_n div {block_rows}"))
    order = once.select(F.col("source").alias("_o"), F.col("k").alias("_k"), "q", "period", F.col("slot").alias("_slot"))
    order = F.broadcast(order) if slots <= BROADCAST_SLOTS else order
    if quanta:
        shares = once.groupBy(F.col("source").alias("_s")).agg(F.max("q").alias("_q"))
        shares = F.broadcast(shares) if slots <= BROADCAST_SLOTS else shares
        numbered = numbered.join(shares, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_at", F.expr("block % _q"))
    else:
        numbered = numbered.withColumn("_at", F.col("block"))
    placed = numbered.join(order, F.col("source").eqNullSafe(F.col("_o")) & (F.col("_at") == F.col("_k")), "left")
    return placed.select(
        "_doc.*", "q", "period", "block",
        F.expr("block div q * period + _slot" if quanta else "_slot").alias("slot"),
        F.expr("block * period div q").alias("release"),
        F.expr("((block + 1) * period + q - 1) div q").alias("deadline"),
        F.expr(f"_n % {block_rows}").alias("place"),
    )


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, tempered(docs), quanta=256)  # its SQL says so


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all of them, in mixed order: files sort like their order, and rows within."""
    keys = docs.select("doc_id", "source")
    order = cut(mix(keys.where("doc_id is not null").distinct(), tempered(keys), quanta=None).select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), "slot", "place"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = order.agg(F.max("slot")).first()[0] or 0
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source")  # so no column's name can clash
    mixed = whole.join(order, (F.col("doc_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_from")), "left")
    part = F.least(F.lit(parts - 1), F.expr(f"coalesce(slot, 0) * {parts} div {last + 1}").cast("int"))
    return mixed.repartitionById(parts, part).sortWithinPartitions("slot", "place").select("_doc.*")


OP1_SQL = """
WITH RECURSIVE w AS (SELECT source, sqrt(count(*)::DOUBLE) AS weight, count(*) AS n FROM documents GROUP BY source),
q0 AS (SELECT source, greatest(1, floor(256 * weight / (SELECT sum(weight) FROM w) + 0.5))::BIGINT AS q FROM w),
q AS (SELECT source, q, row_number() OVER (ORDER BY source NULLS FIRST) AS i, sum(q) OVER ()::BIGINT AS p FROM q0),
a AS (SELECT list(q ORDER BY i) AS qs, max(p) AS p, max(i) AS n FROM q),
e(t, taken, pick) AS (
  SELECT -1::BIGINT, list_transform(qs, lambda x: 0::BIGINT), 0::BIGINT FROM a
  UNION ALL
  SELECT t + 1, list_transform(taken, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best
  FROM (
    SELECT e.t, e.taken, p, (list_sort(list_filter(
      list_transform(range(1, n + 1), lambda i: CASE WHEN taken[i] < qs[i] AND taken[i] * p // qs[i] <= e.t + 1
        THEN [((taken[i] + 1) * p + qs[i] - 1) // qs[i], i] END), lambda x: x IS NOT NULL)))[1][2] AS best
    FROM e, a WHERE e.t + 1 < p)
),
s AS (SELECT t AS slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM e WHERE pick > 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) - 1 AS n FROM documents)
SELECT d.doc_id, d.source, q.q, q.p AS period, n // 16 AS block, n // 16 // q.q * q.p + s.slot AS slot,
  n // 16 * q.p // q.q AS release, ((n // 16 + 1) * q.p + q.q - 1) // q.q AS deadline, n % 16 AS place
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN s ON s.i = q.i AND s.k = (n // 16) % q.q
"""
