"""Mixing sources to target weights by Pfair scheduling with earliest deadline first.

A source of weight w out of the total W has its block b (from 0) released at slot floor(b * W / w) and
due by slot ceil((b + 1) * W / w). In each slot the released block with the earliest deadline runs; ties
go to the source that comes first by name; a slot that no block is released for stays empty. The weights
add up to W, so every block runs inside its window and after any number of slots each source is less
than one block away from its weight, until a source runs dry.

Time is cut into segments of some hundred blocks that are worked out side by side (``exact_schedule``).
What a segment starts from, the blocks that each source has run by then, is guessed: all blocks that are
due, and of those released but not due the ones with the earliest deadlines. A wrong guess is wrong by a
few blocks, and two schedules from different starts run into each other, mostly within tens of slots.
Segments whose guess isn't what the segment before ended with are worked out again from that, until all
agree; then the schedule is the one that a single pass over all slots makes. Every round settles at least
one segment more, so it ends; usually two rounds do.

A row holds three numbers per source, and segments are longer the more sources there are, so what is
held for all segments grows with the blocks alone. Documents find their slot with a shuffled join.

Documents are ranked inside their source by the hash of their id in two steps, counts by hash prefix
and then rows inside a prefix, so a source with a third of all rows is spread over as many partitions
as it has prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import read_table, row_hash, staged

BLOCK = 16
#: Least blocks in a segment of the schedule; SOURCE_STEPS times the sources where that is more.
STEPS = 512
SOURCE_STEPS = 4
ROWS_PER_PREFIX = 2000


def source_weights(counts: DataFrame, weights: DataFrame | None, block: int) -> DataFrame:
    """One row: ``sources`` array of (name, share, blocks) by name, null first, and ``total`` of the shares.

    ``weights`` has (source, weight bigint). Without it a source weighs the square root of its rows in
    thousandths. A source without a positive weight weighs 1. Shares are weights divided by what all share.
    """
    if weights is None:
        weighed = counts.select("name", "rows", F.floor(F.sqrt("rows") * 1000).alias("weight"))
    else:
        given = weights.select(F.col("source").alias("given"), F.col("weight").cast("long").alias("weight"))
        weighed = counts.join(given, F.col("name").eqNullSafe(F.col("given")), "left").select("name", "rows", "weight")
    source = F.struct(F.col("name").isNotNull().alias("named"), "name", F.greatest(F.lit(1), F.coalesce("weight", F.lit(0))).cast("long").alias("weight"),
                      F.ceil(F.col("rows") / block).cast("long").alias("blocks"))
    euclid = "aggregate(sequence(1, 92), named_struct('a', x, 'b', y.weight), (p, i) -> if(p.b = 0, p, named_struct('a', p.b, 'b', p.a % p.b)), p -> p.a)"
    return weighed.agg(F.array_sort(F.collect_list(source)).alias("s")).selectExpr(
        "s", f"greatest(1L, aggregate(s, 0L, (x, y) -> {euclid})) as common",
    ).selectExpr("transform(s, x -> struct(x.name as name, x.weight div common as share, x.blocks as blocks)) as sources").selectExpr(
        "sources", "aggregate(sources, 0L, (x, y) -> x + y.share) as total")


def _segments(sources: DataFrame) -> DataFrame:
    """(start, stop, total, shares, blocks, ran) of segments with about as many blocks each.

    Between two sources running dry blocks come evenly, so each such span is cut into equal parts.
    """
    arrays = sources.where("size(sources) > 0").selectExpr(
        "sources.share as shares", "sources.blocks as blocks", "total",
        "array_sort(array_distinct(transform(sources, x -> (x.blocks * total + x.share - 1) div x.share))) as dry")
    spans = arrays.selectExpr("*", "posexplode(dry) as (i, hi)").selectExpr(
        "shares", "blocks", "total", "hi", "if(i = 0, 0L, dry[i - 1]) as lo",
        "aggregate(zip_with(shares, blocks, (w, n) -> if((n * total + w - 1) div w >= hi, w, 0L)), 0L, (x, y) -> x + y) as active")
    parts = spans.selectExpr("*", f"cast(active / total * (hi - lo) / greatest({STEPS}, {SOURCE_STEPS} * size(shares)) as bigint) + 1 as parts")
    cuts = parts.selectExpr("*", "explode(sequence(0L, parts - 1)) as k").selectExpr(
        "lo + (hi - lo) * k div parts as start", "lo + (hi - lo) * (k + 1) div parts as stop", "total", "shares", "blocks")
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cuts.repartition(tasks, "start").selectExpr(
        "*", "zip_with(shares, blocks, (w, n) -> least(n, w * start div total)) as over",
    ).selectExpr("*", """
        slice(array_sort(filter(
          transform(over, (f, s) -> if(f < blocks[s] and f * total < shares[s] * start, struct(((f + 1) * total + shares[s] - 1) div shares[s] as due, s as s), null)),
          x -> x is not null)), 1, int(least(size(over), greatest(0, start - aggregate(over, 0L, (x, y) -> x + y))))).s as ahead""",
    ).selectExpr("start", "stop", "total", "shares", "blocks", "transform(over, (f, s) -> f + int(array_contains(ahead, s))) as ran")


def _folded(segments: DataFrame) -> DataFrame:
    """``segments`` with ``done``, what each source has run by ``stop``, and ``picks``: (s, block, slot) of every block."""
    steps = "int(greatest(0, aggregate(transform(shares, (w, s) -> least(blocks[s], (w * stop + total - 1) div total) - ran[s]), 0L, (x, y) -> x + y)))"
    step = """
        aggregate(array_repeat(0, steps),
          named_struct('ran', ran, 'slot', start, 'picks', cast(array() as array<struct<s: int, block: bigint, slot: bigint>>)),
          (st, i) -> transform(
            array(array_min(transform(shares, (w, s) -> if(st.ran[s] < blocks[s], greatest(st.slot, st.ran[s] * total div w), null)))),
            t -> if(t is null or t >= stop, st, transform(
              array(array_min(transform(shares, (w, s) -> if(st.ran[s] < blocks[s] and st.ran[s] * total div w <= t,
                struct(((st.ran[s] + 1) * total + w - 1) div w as due, s as s), null))).s),
              p -> named_struct('ran', transform(st.ran, (n, s) -> n + int(s = p)), 'slot', t + 1,
                'picks', concat(st.picks, array(named_struct('s', p, 'block', st.ran[p], 'slot', t)))))[0]))[0])"""
    return segments.selectExpr("*", f"{steps} as steps").selectExpr("start", "stop", "total", "shares", "blocks", "ran", f"{step} as fold").selectExpr(
        "start", "stop", "total", "shares", "blocks", "ran", "fold.ran as done", "fold.picks as picks")


def exact_schedule(sources: DataFrame) -> DataFrame:
    """(s, block, slot) of every block of ``sources`` (one row, as ``source_weights`` makes it), s from 0 in their order."""
    state = ["start", "stop", "total", "shares", "blocks", "ran", "done"]
    rounds = [staged(_folded(_segments(sources)), "mix-folds")]
    now = rounds[0].select(*state, F.lit(0).alias("made"))
    while True:
        ends = now.select(F.col("stop").alias("start"), F.col("done").alias("before"))
        wrong = staged(now.join(ends, "start").where("ran != before").select("start", "stop", "total", "shares", "blocks", F.col("before").alias("ran")), "mix-wrong")
        if wrong.isEmpty():
            break
        again = staged(_folded(wrong.repartition(int(wrong.sparkSession.conf.get("spark.sql.shuffle.partitions")), "start")), "mix-folds")
        now = staged(now.join(again.select("start"), "start", "left_anti").select(*state, "made").unionByName(again.select(*state, F.lit(len(rounds)).alias("made"))), "mix-states")
        rounds.append(again)
    picks = reduce(DataFrame.unionByName, [made.select("start", "picks", F.lit(k).alias("made")) for k, made in enumerate(rounds)])
    kept = picks if len(rounds) == 1 else picks.join(now.select("start", "made"), ["start", "made"])
    return kept.select(F.explode("picks").alias("p")).select("p.*")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` as struct ``row`` with mix_rank, mix_share, mix_block, mix_slot, mix_release, mix_deadline.

    Reading by (mix_slot, mix_rank) gives the mix: block after block, ``block`` documents in each.
    A null source is a source of its own. Null ids count as empty text. Equal ids are placed by a hash of
    their rows, and repeated rows keep separate places. Slots for which a source that has run dry was due
    go to blocks that are released by then, or stay empty; nothing is dropped. An empty table gives no rows.
    mix_share is the weight, divided by what all weights share; a source without a positive weight weighs 1.
    Any number of sources will do; the work is one step a block, each as long as there are sources. Numbers
    beyond a long (blocks times the sum of shares) are an error.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("name"),
                       F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("hash"), row_hash(docs).alias("rest"))
    counts = staged(rows.groupBy("name").agg(F.count("*").alias("rows")), "mix-counts")
    n_rows = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    digits = 1
    while digits < 8 and n_rows > ROWS_PER_PREFIX * 16 ** digits:
        digits += 1
    rows = rows.withColumn("prefix", F.substring("hash", 1, digits))
    before = Window.partitionBy("name").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("name", "prefix").agg(F.count("*").alias("n")).select(
        F.col("name").alias("s_name"), F.col("prefix").alias("s_prefix"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("name", "prefix").orderBy("hash", F.col(f"row.`{doc_id}`"), "rest")
    ranked = rows.join(starts, F.col("name").eqNullSafe(F.col("s_name")) & (F.col("prefix") == F.col("s_prefix"))).select(
        "row", "name", (F.col("start") + F.row_number().over(inside) - 1).alias("mix_rank"))
    sources = staged(source_weights(counts, weights, block), "mix-sources")
    named = sources.selectExpr("total", "posexplode(sources) as (s, x)").selectExpr("s", "total", "x.name as w_name", "x.share as mix_share")
    slots = exact_schedule(sources).join(named, "s").select("w_name", "mix_share", "total", F.col("block").alias("t_block"), F.col("slot").alias("mix_slot"))
    numbered = ranked.withColumn("mix_block", F.expr(f"mix_rank div {block}"))
    return numbered.join(slots, F.col("name").eqNullSafe(F.col("w_name")) & (F.col("mix_block") == F.col("t_block"))).selectExpr(
        "row", "mix_rank", "mix_share", "mix_block", "mix_slot", "mix_block * total div mix_share as mix_release", "((mix_block + 1) * total + mix_share - 1) div mix_share as mix_deadline")


def mixed(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with mix_slot, mix_rank and mix_block; a name that ``docs`` has already gets a _ at its end, and the column given stays."""
    taken = {c.lower() for c in docs.columns}
    names = {}
    for name in ("mix_slot", "mix_rank", "mix_block"):
        names[name] = name
        while names[name] in taken:
            names[name] += "_"
    return mix_sources(docs, weights, **options).select("row.*", *[F.col(k).alias(v) for k, v in names.items()])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix; a source weighs the square root of its rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("row.doc_id", "row.source", "mix_rank", "mix_share", "mix_block", "mix_slot", "mix_release", "mix_deadline")


#: The same by a recursive query, one block a step.
OP6_SQL = f"""
with recursive c as (select source, count(*) as n from documents group by source),
w as (select source, (n + {BLOCK - 1}) // {BLOCK} as bl, greatest(1, cast(floor(sqrt(n) * 1000) as bigint)) as w from c),
g as (select list_reduce(list(w), lambda x, y: gcd(x, y)) as d from w),
a as (select list(w // d order by source nulls first) as sh, list(bl order by source nulls first) as bl, list(source order by source nulls first) as nm,
  cast(sum(w // d) as bigint) as total from w, g),
r as (
  select cast(0 as bigint) as step, list_transform(sh, lambda x: cast(0 as bigint)) as ran, cast(0 as bigint) as slot, cast(null as bigint) as pick, cast(null as bigint) as blk, sh, bl, total from a
  union all
  select step + 1, list_transform(ran, lambda n, i: n + case when i = p then 1 else 0 end), t + 1, p, ran[p], sh, bl, total
  from (select *, list_min(list_transform(list_filter(range(1, len(sh) + 1), lambda s: ran[s] < bl[s] and ran[s] * total // sh[s] <= t),
          lambda s: ((ran[s] + 1) * total + sh[s] - 1) // sh[s] * 100000 + s)) % 100000 as p
        from (select *, greatest(slot, list_min(list_transform(list_filter(range(1, len(sh) + 1), lambda s: ran[s] < bl[s]), lambda s: ran[s] * total // sh[s]))) as t
              from r where step < list_sum(bl)) x) y
),
slots as (select nm[pick] as name, r.sh[pick] as share, r.total, blk, slot - 1 as mix_slot from r, a where pick is not null),
k as (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as mix_rank from documents)
select doc_id, source, cast(mix_rank as bigint) as mix_rank, cast(share as bigint) as mix_share, cast(blk as bigint) as mix_block, cast(mix_slot as bigint) as mix_slot,
  cast(blk * total // share as bigint) as mix_release, cast(((blk + 1) * total + share - 1) // share as bigint) as mix_deadline
from k join slots s on k.source is not distinct from s.name and k.mix_rank // {BLOCK} = s.blk
"""
