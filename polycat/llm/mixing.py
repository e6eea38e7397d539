"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks, and time has a slot for each block.  Ideally
each source would be served all the time, at the rate of its weight among the
sources that aren't used up: while tau grows, a source of weight w and l blocks gets
min(w tau, l), and the time until tau is t(tau), the sum of these over all sources.
Block j of a source is released in slot floor(t((j - 1) / w)) and has its deadline
before slot ceil(t(j / w)).  Earliest deadline first places each block between the two:
of the blocks that end within any span of slots no more are released in it than it
has slots.  So at every slot, over all that was placed before, every source is within
less than one block of its ideal share; nothing starts anew where a source runs
out.  Weights are integers (of 60 bits), and so are all comparisons.

Slots are scheduled in segments, all at the same time, since which blocks are
placed before slot K is known without a schedule of those slots.  They are all whose
deadline is up to K, and of those that are released before K and due after it (one of
each source at most) some K - D, where D is the number of the former.  Let
backlog(a) be the number of blocks released before slot a, less a.  Of any set of
blocks that has the first deadlines, as many are placed before K as the least of K
and, for every slot a up to K, K + backlog(a) - (blocks released before a that
aren't in the set).  So a block is placed before K if that number grows when it is added to
those with earlier deadlines.

All of it is DataFrame operations.  The driver has a few numbers for each source.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polycat.llm.shared import Workspace

#: Blocks in a row of the schedule's table.
CHUNK = 1024
#: Rows of a block, at least, and how many blocks (and one for each source) there are at most, whatever the input.
LEAST_BLOCK, MOST_BLOCKS = 16, 1 << 20
#: Slots of a segment, at least; it has eight for each source, too.
SEGMENT, PER_SOURCE = 1024, 8
BITS = 60

DEC = "decimal(38,0)"
SOURCES = f"array<struct<k:int,w:{DEC},l:bigint,rank:int>>"
#: After how many slots the first sources ran out, and what W and D in t(tau) = W tau + D are from then on.
PHASES = f"array<struct<e:bigint,w:{DEC},d:bigint>>"
LIVE = f"array<struct<k:int,w:{DEC},l:bigint,j:bigint,r:bigint,d:bigint>>"
PICKS = "array<struct<k:int,j:bigint>>"


def _phases(sources: list[tuple[int, int]]) -> tuple[list[dict], list[dict]]:
    """Sources (blocks, weight) by the order in which they run out, and the phases between."""
    order = sorted(range(len(sources)), key=lambda k: Fraction(*sources[k]))
    rank = {k: n for n, k in enumerate(order)}
    rate, gone = sum(w for _, w in sources), 0
    phases = [{"e": -1, "w": rate, "d": 0}]
    for k in order:
        n, w = sources[k]
        end = rate * n // w + gone
        rate, gone = rate - w, gone + n
        phases.append({"e": end, "w": rate, "d": gone})
    return [{"k": k, "w": w, "l": n, "rank": rank[k]} for k, (n, w) in enumerate(sources)], phases


def _time(j: str, w: str, up: bool = False) -> str:
    """t(j / w), rounded down or up to a slot."""
    total = f"aggregate(sources, cast(0 as {DEC}), (a, s) -> cast(a + least(s.w * cast({j} as {DEC}), cast(s.l as {DEC}) * {w}) as {DEC}))"
    return f"(({total} + {w} - 1) div {w})" if up else f"({total} div {w})"


def _share(x: str, at: str, phase: str, passed: str, up: bool = False) -> str:
    """How many blocks of a source are ideally placed before a slot, rounded down or up."""
    part = f"{x}.w * cast({at} - {phase}.d as {DEC})"
    return f"if({x}.rank < {passed}, {x}.l, {f'({part} + {phase}.w - 1)' if up else f'({part})'} div {phase}.w)"


def _passed(at: str) -> str:
    """How many sources ran out before a slot."""
    return f"(size(filter(phases, p -> p.e < {at})) - 1)"


def schedule(spark: SparkSession, sources: list[tuple[int, int]]) -> DataFrame:
    """The slot of every block of sources (blocks, weight; positive integers): (k, block, slot), blocks from 0.

    Of blocks with one deadline the source that comes first in the list has its first.  The
    driver gets a few numbers for each source, and one for each segment.
    """
    listed, phases = _phases(sources)
    blocks, length = sum(n for n, _ in sources), max(SEGMENT, PER_SOURCE * len(sources))
    constant = {"sources": F.from_json(F.lit(json.dumps(listed)), SOURCES), "phases": F.from_json(F.lit(json.dumps(phases)), PHASES)}
    work = Workspace(spark, "schedule")
    parts = spark.range(-(-blocks // length)).select("id", (F.col("id") * length).alias("a"), F.least((F.col("id") + 1) * length, F.lit(blocks)).alias("b"), *(c.alias(n) for n, c in constant.items()))
    # How many of each source's blocks are ideally placed before the segment; those that might be; and the backlog at each slot.
    parts = parts.selectExpr("*", f"{_passed('a')} as passed").selectExpr("*", "phases[passed] as phase")
    parts = parts.selectExpr("*", f"transform(sources, x -> struct(x.k, x.w, x.l, {_share('x', 'a', 'phase', 'passed')} as low, {_share('x', 'a', 'phase', 'passed', True)} as high)) as shares")
    parts = parts.selectExpr("*", f"array_sort(transform(filter(shares, x -> x.low < x.high), x -> struct({_time('x.low + 1', 'x.w', True)} as d, x.k, {_time('x.low', 'x.w')} as r))) as maybe")
    backlog = f"transform(transform(sequence(a, b - 1), t -> struct(t, {_passed('t')} as n)), q -> aggregate(sources, -q.t, (n, x) -> n + {_share('x', 'q.t', 'phases[q.n]', 'q.n', True)}))"
    parts = work.save(parts.selectExpr("id", "a", "b", "shares", "maybe", f"{backlog} as backlog"), "parts")
    # The least backlog from each release to the segment: a number for each segment goes through the driver.
    least = [r["n"] for r in parts.select("id", F.array_min("backlog").alias("n")).orderBy("id").collect()]
    asked = parts.select("id", F.get("backlog", F.lit(0)).alias("here"), F.explode("maybe").alias("m")).select("id", "here", "m.k", (F.col("m.r") + 1).alias("x"), F.floor((F.col("m.r") + 1) / length).alias("p"))
    there = parts.select(F.col("id").alias("p"), F.col("a").alias("_a"), F.col("backlog").alias("_backlog"))
    between = F.array_min(F.slice(F.from_json(F.lit(json.dumps(least)), "array<bigint>"), (F.col("p") + 2).cast("int"), F.greatest(F.col("id") - F.col("p") - 1, F.lit(0)).cast("int")))
    rest = F.array_min(F.slice("_backlog", (F.col("x") - F.col("_a") + 1).cast("int"), length))
    found = asked.join(there, "p").select("id", "k", F.when(F.col("p") == F.col("id"), F.col("here")).otherwise(F.least("here", rest, between)).alias("n"))
    lows = work.save(found.groupBy("id").agg(F.collect_list(F.struct("k", "n")).alias("lows")), "lows")
    parts = parts.join(lows, "id", "left").withColumns(constant)
    # Of those that might be placed before the segment, the ones that are.
    room = "transform(maybe, m -> struct(m.r, filter(lows, x -> x.k = m.k)[0].n - size(filter(maybe, o -> o.r <= m.r)) as n))"
    after = "transform(st.room, q -> struct(q.r, if(q.r >= m.r, q.n + 1, q.n) as n))"
    grown = "if(least(0L, array_min(transform(room, q -> q.n))) > least(0L, array_min(transform(st.room, q -> q.n))), concat(st.taken, array(m.k)), st.taken)"
    taken = f"transform(array({after}), room -> named_struct('room', room, 'taken', {grown}))[0]"
    parts = parts.selectExpr("*", f"aggregate(maybe, named_struct('room', {room}, 'taken', cast(array() as array<int>)), (st, m) -> {taken}).taken as taken")
    # What is left of each source, from its next block on.
    begun = "transform(shares, x -> struct(x.k, x.w, x.l, x.low + if(array_contains(taken, x.k), 1L, 0L) as j))"
    parts = parts.selectExpr("a", "b", "sources", f"cast(transform(filter({begun}, x -> x.j < x.l), x -> struct(x.k, x.w, x.l, x.j, {_time('x.j', 'x.w')} as r, {_time('x.j + 1', 'x.w', True)} as d)) as {LIVE}) as live")
    first = "array_min(transform(filter(st.live, x -> x.r <= t), x -> struct(x.d, x.k, x.j)))"
    moved = f"if(x.k = c.k, struct(x.k, x.w, x.l, x.j + 1 as j, {_time('x.j + 1', 'x.w')} as r, {_time('x.j + 2', 'x.w', True)} as d), x)"
    placed = f"named_struct('live', filter(transform(st.live, x -> {moved}), x -> x.j < x.l), 'picks', concat(st.picks, array(struct(c.k, c.j))))"
    step = f"transform(array({first}), c -> {placed})[0]"
    picks = f"aggregate(sequence(a, b - 1), named_struct('live', live, 'picks', cast(array() as {PICKS})), (st, t) -> {step}).picks"
    return parts.selectExpr("a", f"posexplode({picks}) as (place, pick)").selectExpr("pick.k as k", "pick.j as block", "a + place as slot")


def _integers(weights: list[float], natural: bool) -> list[int]:
    """Weights as integers: times 2^40 where they follow from numbers of rows, else as parts of the largest; none that is positive becomes 0."""
    unit = Fraction(1 << 40) if natural else Fraction(1 << BITS) / Fraction(max(weights))
    return [max(1, math.floor(Fraction(w) * unit)) for w in weights]


def mix(docs: DataFrame, weights: dict | None = None, *, source: str = "source", key: str = "doc_id", block: int | None = None, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """``docs`` in the order of the mixture: all rows and columns, and ``mix_slot``, ``mix_offset`` and ``mix_position``.

    ``weights``: source to target weight.  Sources without one get the weight that
    ``alpha`` gives them, (rows)^alpha, scaled so that a source with a weight of 1
    has that of a mean one; without ``weights`` all sources do.  A null source is a
    source.  Each source's documents come in the order of a hash of their key (its
    first 12 bits deal them into groups that are numbered by themselves), in
    blocks of ``block`` (the last may be shorter); without ``block``, of 16, or of
    as many as a ``MOST_BLOCKS``-th of all rows if that is more.  ``mix_slot`` is the block's slot,
    ``mix_offset`` the place in the block, ``mix_position`` the place in the mixture,
    from 0 without gaps.  At every slot the blocks placed of each source differ by less
    than one from its share of all slots so far, where a source that is used up
    leaves its rate to the others in proportion.  Sources of weight 0 come after all
    others, as many blocks of each.  Rows that repeat are each placed; no rows give
    none.  The driver holds a few numbers for each source and for each thousand blocks, none for rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    docs = docs.drop("mix_slot", "mix_offset", "mix_position")
    shown = docs.columns
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    named = F.to_json(F.struct(F.col(source).cast("string").alias("s")))
    # The table's own columns travel as one, so that no name of theirs meets one of these.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in shown)).alias("_kept"), F.col(key).alias("_id"), h.alias("_h"), F.substring(h, 1, 3).alias("_g"), named.alias("_s"))
    counts = work.save(rows.groupBy("_s", "_g").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_s", "_g", F.coalesce(before, F.lit(0)).alias("_before"))
    sizes = {r["_s"]: r["n"] for r in counts.groupBy("_s").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    block = block or max(LEAST_BLOCK, -(-sum(sizes.values()) // MOST_BLOCKS))
    given = {_shown(s): float(w) for s, w in (weights or {}).items()}
    sizes = dict(sorted(sizes.items()))
    natural = {s: math.sqrt(n) if alpha == 0.5 else n**alpha for s, n in sizes.items()}
    mean = sum(natural.values()) / max(1, len(sizes)) if given else 1.0  # without given weights only proportions matter
    target = {s: given.get(s, natural[s] / mean) for s in sizes}
    # Sources without a weight come when all others ran out.
    eras = [[s for s in target if target[s] > 0], [s for s in target if target[s] <= 0]]
    start, slots = 0, None
    for era, names in enumerate(eras):
        if not names:
            continue
        whole = [-(-sizes[s] // block) for s in names]
        numbers = _integers([target[s] for s in names], not given) if not era else [1] * len(names)
        named_k = F.from_json(F.lit(json.dumps([{"s": s, "l": n, "m": -sizes[s] % block} for s, n in zip(names, whole, strict=True)])), "array<struct<s:string,l:bigint,m:bigint>>")
        found = schedule(spark, list(zip(whole, numbers, strict=True))).withColumn("_x", F.element_at(named_k, F.col("k") + 1))
        found = found.select(F.col("_x.s").alias("_s"), F.col("block").alias("_block"), (F.col("slot") + start).alias("_slot"), F.when(F.col("block") + 1 == F.col("_x.l"), F.col("_x.m")).otherwise(0).alias("_missing"))
        start += sum(whole)
        slots = found if slots is None else slots.unionByName(found)
    if slots is None:
        slots = spark.createDataFrame([], "_s string, _block bigint, _slot bigint, _missing bigint")
    slots = work.save(slots, "slots")
    # What is missing of the sources' last blocks, from the slots after them on: a row for each source at most.
    short = [{"t": r["_slot"], "m": r["_missing"]} for r in slots.where("_missing > 0").select("_slot", "_missing").collect()]
    before_it = F.filter(F.from_json(F.lit(json.dumps(short)), "array<struct<t:bigint,m:bigint>>"), lambda x: x["t"] < F.col("_slot"))
    gone = F.aggregate(before_it, F.lit(0).cast("bigint"), lambda n, x: n + x["m"])
    listed = F.sort_array(F.collect_list(F.struct("_block", "_slot", (F.col("_slot") * block - gone).alias("_start"))))
    chunks = slots.groupBy("_s", F.floor(F.col("_block") / CHUNK).alias("_chunk")).agg(listed.alias("_listed"))
    schedule_df = work.save(chunks.select("_s", "_chunk", F.col("_listed._slot").alias("_slots"), F.col("_listed._start").alias("_starts")), "schedule")
    work.drop("slots")
    if start <= 2 * MOST_BLOCKS:  # 16 bytes a block; more only where a caller wants small blocks, or has as many sources
        schedule_df = F.broadcast(schedule_df)
    # Each block's slot, from the row that has it.
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_g").orderBy("_h", "_id")))
    # Merged, since rows are dealt and sorted by group already: nothing of the size of groups times sources is broadcast.
    placed = numbered.join(offsets.hint("merge"), ["_s", "_g"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)
    placed = placed.withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_offset", F.col("_rank") % block)
    joined = placed.withColumn("_chunk", F.floor(F.col("_block") / CHUNK)).join(schedule_df, ["_s", "_chunk"])
    at = (F.col("_block") % CHUNK + 1).cast("int")
    slot, position = F.element_at("_slots", at), F.element_at("_starts", at) + F.col("_offset")
    return joined.select(*(F.col(f"_kept.`{c}`").alias(c) for c in shown), slot.alias("mix_slot"), F.col("_offset").alias("mix_offset"), position.alias("mix_position"))


def _shown(value) -> str:
    """A source's name as the plan has it."""
    return "{}" if value is None else json.dumps({"s": str(value)}, ensure_ascii=False, separators=(",", ":"))
