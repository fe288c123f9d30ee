"""Mixing sources to target weights by Pfair scheduling (native).

Each source's documents, in id order, are cut into blocks.  A cycle of slots
holds as many slots of a source as its target weight asks for.  Block ``k`` of
a source with ``c`` of ``P`` slots is released at floor(k P / c) and due at
ceil((k + 1) P / c); in every slot the released block with the earliest
deadline goes next.  As the weights fill the cycle exactly, every block meets
its window, so at any slot each source is less than one block away from its
target.  Later cycles repeat the first one.

Where a source's weight is below one slot, sources of about equal weight share
the slots of a pool in turn, over a longer cycle.  Block ``k`` of the pool's member ``i`` of ``n``
is the pool's block ``k n + i``, whose window lies within the member's own one
at ``c / n`` of ``P`` slots, so the pool's schedule keeps every member's.

Only the cycle, a table of fixed size, is scheduled step by step; every
document finds its slot by arithmetic and a join with that table.  No document
is dropped or repeated: where a source has run out its slots stay empty and
the others follow in their order.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_names, maybe_broadcast, save, shared_dir
from corpusloom.operators.prefix import ordered_prefix

#: Slots of a cycle: target weights hold to 1 / CYCLE.
CYCLE = 1000
#: Documents of a block.
BLOCK_ROWS = 16
#: Slots of a cycle with pools, in CYCLEs; weight in slots from which a source has its own there.
POOLED, OWN = 4, 16
#: Pools by weight, so many to a factor of two: of sources with a slot or more, and with less.  The finer ones keep every
#: member within one block of its target over a cycle, as 16 (2^(1/12) - 1) < 1; a lighter one has less than a block.
FINE, STEPS = 12, 4


def source_key(col: str) -> Column:
    """A source's name with a mark, so that null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{col}`").cast("string")), F.lit(""))


def slots(sizes: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """``(key, c)``: slots per cycle from ``sizes`` (``key``, ``weight``, one
    row per source or pool).  Slots go by weight, what rounding leaves to the
    largest remainders (ties: by name); an entry whose weight is below one slot
    gets one before.  The windows hold one row per entry, fewer than slots."""
    every = Window.partitionBy(F.lit(0))
    share = sizes.withColumn("least", F.lit(cycle) * F.col("weight") / F.sum("weight").over(every) < 1 - 1e-9)
    rest = F.when(F.col("least"), 0.0).otherwise(F.col("weight"))
    share = (share.withColumn("few", F.sum(F.col("least").cast("int")).over(every))
             .withColumn("x", F.when(F.col("least"), 1.0).otherwise((F.lit(cycle) - F.col("few")) * rest / F.sum(rest).over(every))))
    low = share.withColumn("c", F.floor("x").cast("int")).withColumn("rest", F.round(F.col("x") - F.floor("x"), 9))
    left = F.lit(cycle) - F.sum("c").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("rest"), "key"))
    return low.withColumn("left", left).withColumn("rank", rank).select(
        "key", (F.col("c") + (F.col("rank") <= F.col("left")).cast("int")).alias("c"))


def schedule(targets: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """``(key, c, j, slot, release, deadline)``: the earliest-deadline-first
    cycle, one row per slot."""
    state = targets.agg(F.array_sort(F.collect_list(F.struct("key", "c"))).alias("s")).select("s", F.col("s.c").alias("c"))
    pick = """array_min(filter(transform(c, (n, i) -> CASE WHEN a.done[i] < n AND a.done[i] * {P} DIV n <= t
              THEN ((a.done[i] + 1) * {P} + n - 1) DIV n * 1000000 + i END), x -> x IS NOT NULL)) % 1000000"""
    step = f"""aggregate(sequence(0, {cycle - 1}), named_struct('done', transform(c, n -> 0L), 'order', array(0L)),
        (a, t) -> transform(array({pick.format(P=cycle)}),
            p -> named_struct('done', transform(a.done, (d, i) -> d + IF(i = p, 1L, 0L)), 'order', concat(a.order, array(p))))[0],
        a -> slice(a.order, 2, {cycle}))"""
    chosen = state.select("s", F.posexplode(F.expr(step)).alias("slot", "i")).select("slot", F.expr("get(s, int(i)).key").alias("key"), F.expr("get(s, int(i)).c").alias("c")).where("key is not null")
    j = F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1
    return chosen.withColumn("j", j).select(
        "key", "c", "j", "slot", F.expr(f"j * {cycle} DIV c").alias("release"), F.expr(f"((j + 1) * {cycle} + c - 1) DIV c").alias("deadline"))


def pooled(sizes: DataFrame, cycle: int) -> DataFrame:
    """``sizes`` (``key``, ``n``, ``weight``) with the ``pool`` of each source.
    At most ``cycle / OWN`` sources are heavy enough for one of their own.
    Others share pools of about equal weight; pools that do not fill a slot
    become one, whose members have less than a block in a cycle."""
    share = F.col("weight") / F.lit(sizes.agg(F.sum("weight")).first()[0]) * F.lit(cycle)
    step = F.log2("share")
    name = (F.when(F.col("share") >= OWN, F.col("key")).when(F.col("share") >= 1, F.concat(F.lit("#"), F.floor(step * FINE).cast("string")))
            .when(F.col("share") > 0, F.concat(F.lit("#-"), F.floor(step * STEPS).cast("string"))).otherwise(F.lit("#")))
    named = sizes.withColumn("share", share).withColumn("pool", name)
    # pools of light sources: at most as many as there are steps between the doubles
    full = (named.where("share < 1").groupBy("pool").agg(F.sum("share").alias("held")).where("held >= 1")
            .select("pool", F.lit(True).alias("full")))
    return named.join(F.broadcast(full), "pool", "left").select(
        "key", "n", "weight", F.when((F.col("share") >= 1) | F.col("full"), F.col("pool")).otherwise(F.lit("#")).alias("pool"))


def members(sizes: DataFrame) -> DataFrame:
    """``sizes`` (with ``pool``) and each source's place ``nth`` (from 0) among
    the ``of`` sources of its pool, by the hash of its name."""
    hashed = sizes.withColumn("at", F.shiftrightunsigned(F.xxhash64("key"), 12))
    placed = ordered_prefix(hashed, ["at", "key"], None, "nth", ["pool"], inclusive=False).drop("at")
    return placed.join(F.broadcast(sizes.groupBy("pool").agg(F.count("*").alias("of"))), "pool")


def mix_order(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
              block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """``doc_id``, ``source``, ``block`` (number in its source), ``slot``,
    ``release``, ``deadline`` and ``position`` (from 0) of every row.

    ``weights`` gives target weights by source name; sources it does not name
    share one slot a cycle.  Without it weights go by the square root of a
    source's rows, which raises small sources.  A null source is a source of
    its own; null ids come first in theirs; rows that repeat an id follow each
    other.  If a weight is below one slot of ``cycle``, light sources share slots
    in pools, over a cycle of ``POOLED * CYCLE`` slots at least.  Empty input gives no rows; other
    columns are ignored."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                       source_key(source_col).alias("key"))
    folder = shared_dir(docs.sparkSession, "mixing")
    sizes = base.groupBy("key").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        given = F.create_map(*[x for s, w in weights.items() for x in (F.lit("=" + s), F.lit(float(w)))])
        weight = F.coalesce(given[F.col("key")], F.lit(0.0))
    sizes = save(sizes.withColumn("weight", weight), f"{folder}/sizes")
    least, total = sizes.agg(F.min("weight"), F.sum("weight")).first()
    if total == 0:  # no source is named: all weigh the same
        sizes = save(sizes.withColumn("weight", F.lit(1.0)), f"{folder}/equal")
        least, total = 1.0, float(sizes.count())
    many = total is not None and not least * cycle >= total * (1 - 1e-9)
    if many:
        cycle = max(cycle, POOLED * CYCLE)
        sizes = save(pooled(sizes, cycle), f"{folder}/pools")
        entries = sizes.groupBy("pool").agg(F.sum("weight").alias("weight")).select(F.col("pool").alias("key"), "weight")
        named = members(sizes)
    else:
        entries = sizes.select("key", "weight")
        named = sizes.select("key", "n", F.col("key").alias("pool"), F.lit(0).alias("nth"), F.lit(1).alias("of"))
    plan = save(schedule(slots(entries, cycle), cycle), f"{folder}/cycle")
    # the plan has at most ``cycle`` rows
    targets = named.join(F.broadcast(plan.select(F.col("key").alias("pool"), "c").distinct()), "pool").select("key", "n", "pool", "nth", "of", "c")

    ranked = ordered_prefix(base, ["doc_id"], None, "rank", ["key"], materialize=True).withColumn("block", F.expr(f"(rank - 1) DIV {block_rows}"))
    if many:
        # sources of many rows, at most ``cycle``, are broadcast; the others are joined by shuffle
        targets = save(targets, f"{folder}/targets")
        large = F.col("n") * cycle >= F.lit(targets.agg(F.sum("n")).first()[0])
        rows_of = targets.where(large).drop("n")
        found = ranked.join(F.broadcast(rows_of), "key").unionByName(
            ranked.join(F.broadcast(rows_of.select("key")), "key", "left_anti").join(targets.where(~large).drop("n"), "key"))
    else:
        found = ranked.join(F.broadcast(targets.drop("n")), "key")
    turns = (found.withColumn("at", F.expr("block * of + nth")).withColumn("j", F.expr("int(at % c)"))
             .join(F.broadcast(plan.select(F.col("key").alias("pool"), "j", F.col("slot").alias("first"))), ["pool", "j"]))
    placed = turns.select("doc_id", "source", "rank", "block", F.expr(f"at DIV c * {cycle} + first").alias("slot"),
                          F.expr(f"block * of * {cycle} DIV c").alias("release"),
                          F.expr(f"((block + 1) * of * {cycle} + c - 1) DIV c").alias("deadline"))
    placed = save(placed, f"{folder}/placed")
    blocks = placed.groupBy("slot").agg(F.count("*").alias("rows"))
    first = ordered_prefix(blocks, ["slot"], "rows", "before", inclusive=False, materialize=True).select("slot", "before")
    return (placed.join(first, "slot")
            .select("doc_id", "source", "block", "slot", "release", "deadline",
                    (F.col("before") + (F.col("rank") - 1) % block_rows).alias("position")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """``docs`` in the order of ``mix_order``: range-partitioned and sorted by
    position, so files written from it hold the mix in file order.  Rows with
    equal id and source, whatever their other columns, share the positions of
    that id in any order."""
    id_, key, nth, place = free_names(docs, "_id", "_key", "_n", "_position")
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "mix")
    order = save(mix_order(docs, weights, id_col, source_col, block_rows, cycle)
                 .select(F.col("doc_id").alias(id_), source_key("source").alias(key), F.col("position").alias(place)), f"{folder}/order")
    again = save(order.groupBy(id_, key).agg(F.count("*").alias("c")).where("c > 1").select(id_, key), f"{folder}/again")
    keyed = docs.withColumn(id_, F.col(f"`{id_col}`").cast("long")).withColumn(key, source_key(source_col))

    def same(a: DataFrame, b: DataFrame, *more: str) -> Column:
        found = a[id_].eqNullSafe(b[id_]) & (a[key] == b[key])
        return functools.reduce(lambda x, c: x & (a[c] == b[c]), more, found)

    def placed(rows: DataFrame, places: DataFrame, *more: str) -> DataFrame:
        return rows.join(places, same(rows, places, *more)).select(*[rows[f"`{c}`"] for c in docs.columns], places[place])

    # rows of their own id and source find their place by these; only repeated ones are numbered
    parts = [placed(keyed, maybe_broadcast(order.join(again, same(order, again), "left_anti"), 48))]
    if not again.isEmpty():
        within = Window.partitionBy(id_, key)
        repeated = keyed.join(again, same(keyed, again), "left_semi").withColumn(nth, F.row_number().over(within.orderBy(F.lit(0))))
        places = order.join(again, same(order, again), "left_semi").withColumn(nth, F.row_number().over(within.orderBy(place)))
        parts.append(placed(repeated, places, nth))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = functools.reduce(DataFrame.unionAll, parts)
    return joined.repartitionByRange(n, place).sortWithinPartitions(place).drop(place)
