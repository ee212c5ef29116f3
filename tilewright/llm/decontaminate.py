"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are partitioned by the size of their shingle set into classes [2^c, 2^(c+1)). All items of a
class get a bottom-k MinHash sketch: their k smallest shingle hashes. Containment t of an item of n
shingles leaves at most floor((1 - t) n) of them out, so with k = floor((1 - t) (2^(c+1) - 1)) + 1 at
least k - floor((1 - t) n) >= 1 sketch hashes are in any document that contains the item: the
search loses no pair, however long the document is and wherever in it the shingles stand. A
document of fewer distinct shingles than t times the class's least size is out for the whole class.

The items alone are sketched. A sketch of a document would be its smallest hashes, and a short item
inside a long document has next to none of these, so the sketches of a class are looked up in all hashes
of a document instead; that is the containment form of the search, and it is lossless.

A benchmark of at most ``block`` items and ``item_words`` words goes to the documents as one bounded row:
a document is then one row from the scan to the result, and nothing is shuffled. A larger one, of any
size, is an index of (sketch hash, item) that the documents' hashes are joined with. Hashes that no item
has are left out before that by a bit set of all sketch hashes (``sieve``, at most ``SIEVE_LONGS`` longs),
so next to nothing but hits is shuffled; a hash that very many texts have is dealt into parts. Candidates
(text, item) are verified by a join on (text, shingle), sifted in the same way. Both give the same leaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import bound, read_table, renamed, restored, staged, words_of

SHINGLE = 5
THRESHOLD_PERCENT = 80
#: Items and words of a benchmark that is sent to the documents as one row.
BLOCK = 500
ITEM_WORDS = 200_000
#: Bits of the sieve for each sketch hash, and its most longs (a power of two): a fuller one lets more through, no fewer.
SIEVE_BITS = 16
SIEVE_LONGS = 1 << 20
#: Texts with one hash that are a part; at most HOT_HASHES hashes are dealt into parts, the commonest.
HOT = 100_000
HOT_HASHES = 2000


def _gather(words: str, k: int) -> str:
    """SQL for the hashes of the k-word windows of the array column ``words``."""
    parts = ", ".join(f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(k))
    return f"case when size({words}) >= {k} then transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) else array() end"


def benchmark_items(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per item: item_id, words, k (shingle length), shingles, n, sketch, need, least.

    An item of fewer words than ``shingle`` is one shingle of all its words. Items without words are left
    out. Items with a null id take part; equal ids stay apart.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.lower(F.col(text))).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("k", F.least(F.size("words"), F.lit(shingle)))
    items = items.withColumn("shingles", F.expr("array_sort(array_distinct(transform(sequence(0, size(words) - k), i -> slice(words, i + 1, k))))"))
    hashes = reduce(lambda rest, k: F.when(F.col("k") == k, F.expr(_gather("words", k))).otherwise(rest), range(1, shingle + 1), F.array().cast("array<bigint>"))
    items = items.withColumn("n", F.size("shingles")).withColumn("lower", F.expr("cast(pow(2, floor(log2(n))) as int)"))
    kept = F.expr(f"(2 * lower - 1) * {100 - percent} div 100 + 1").cast("int")
    items = items.withColumn("sketch", F.slice(F.sort_array(F.array_distinct(hashes)), F.lit(1), kept))
    spare = F.expr(f"n * {100 - percent} div 100")
    return items.select("item_id", F.size("words").alias("n_words"), "k", F.transform("shingles", lambda s: F.concat(F.lit(" "), F.array_join(s, " "), F.lit(" "))).alias("shingles"), "n",
                        "sketch", (F.size("sketch") - spare).cast("int").alias("need"), F.expr(f"cast(lower * {percent} div 100 as int)").alias("least"))


def _lengths(items: DataFrame) -> list[int]:
    return sorted(r.k for r in items.select("k").distinct().collect())


def _hashes(words: str, lengths: list[int]) -> Column:
    """Hashes of the windows of all ``lengths`` in the array column ``words``."""
    return F.flatten(F.array(*[F.expr(_gather(words, k)) for k in lengths])) if len(lengths) > 1 else F.expr(_gather(words, lengths[0]))


def _by_one_row(docs: DataFrame, items: DataFrame, text: str, percent: int, kind: str) -> DataFrame:
    """``docs`` with ``_leaks``, for a benchmark that fits into a row."""
    sketches = items.select(F.explode("sketch").alias("h")).agg(F.sort_array(F.collect_set("h"))).scalar()
    table = items.agg(F.sort_array(F.collect_list(F.struct("item_id", "k", "n", "need", "least", "sketch", "shingles")))).scalar()
    rows = bound(docs, "_words", words_of(F.lower(F.col(text))))
    rows = bound(rows, "_hashes", _hashes("_words", _lengths(items)))
    rows = bound(rows, "_hits", F.array_intersect("_hashes", sketches))
    rows = bound(rows, "_items", F.when(F.size("_hits") > 0, table))

    def candidate(item: Column) -> Column:
        return F.size(F.array_intersect(item.sketch, F.col("_hits"))) >= item.need

    def verified(joined: Column, size: Column) -> Column:
        found = F.filter("_items", lambda item: (item.least <= size) & candidate(item))
        counted = F.transform(found, lambda item: F.struct(
            item.item_id.alias("item_id"), item.n.alias("n_item"), F.size(F.filter(item.shingles, lambda s: F.contains(joined, s))).alias("n_shared")))
        return F.filter(counted, lambda x: x.n_shared * 100 >= x.n_item * percent)

    joined = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    once = F.transform(F.array(F.struct(joined.alias("joined"), F.size(F.array_distinct("_hashes")).alias("size"))), lambda x: verified(x.joined, x.size))[0]
    return bound(rows, "_leaks", F.when(F.size("_hits") > 0, once).otherwise(F.array().cast(kind))).drop("_words", "_hashes", "_hits", "_items")


def sieve(index: DataFrame) -> tuple[DataFrame, int]:
    """(one row with the longs of a bit set in array ``bits``, number of bits) in which every ``h`` of ``index`` sets two bits."""
    distinct = index.select("h").distinct()
    n, longs = distinct.count(), 1
    while longs < SIEVE_LONGS and longs * 64 < n * SIEVE_BITS:
        longs *= 2
    mask = longs * 64 - 1
    set_bits = distinct.selectExpr(f"explode(array(h & {mask}L, shiftrightunsigned(h, 32) & {mask}L)) as b").groupBy(F.expr("b div 64").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("value"))
    row = index.sparkSession.range(longs).join(set_bits, F.col("id") == F.col("at"), "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("value", F.lit(0)).alias("value")))), lambda x: x.value).alias("bits"))
    return staged(row, "sieve"), longs * 64


def _sifted(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``hashes`` whose ``h`` has both its bits in the sieve of ``index``."""
    row, n_bits = sieve(index)
    bits = row.scalar()
    probes = [F.col("h").bitwiseAND(F.lit(n_bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(n_bits - 1))]
    tests = [F.getbit(F.get(bits, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in probes]
    return hashes.where(tests[0] & tests[1])


def _dealt(hits: DataFrame, index: DataFrame) -> DataFrame:
    """``hits`` joined with ``index`` on ``h``; a hash of more than ``HOT`` hits meets its items in several parts.

    At most ``HOT_HASHES`` hashes can have that many, since the limit grows with the hits.
    """
    limit = max(HOT, hits.count() // HOT_HASHES)
    hot = staged(hits.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h", F.expr(f"n div {limit} + 1").alias("parts")), "hot-hashes")
    salted = hits.join(F.broadcast(hot), "h", "left").withColumn("part", F.expr("pmod(xxhash64(_digest), coalesce(parts, 1L))")).drop("parts")
    copied = index.join(F.broadcast(hot), "h", "left").withColumn("part", F.expr("explode(sequence(0L, coalesce(parts, 1L) - 1))")).drop("parts")
    return salted.join(copied, ["h", "part"])


def _by_index(docs: DataFrame, items: DataFrame, text: str, percent: int, kind: str) -> DataFrame:
    """``docs`` with ``_leaks``, for a benchmark of any size: leaks are worked out once for each different text."""
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "numbered-items")
    lengths = _lengths(items)
    rows = docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    hashed = bound(rows.select("_digest", text), "_words", words_of(F.lower(F.col(text))))
    hashed = bound(hashed, "_hashes", F.array_distinct(_hashes("_words", lengths)))
    index = items.select("item", "need", "least", F.explode("sketch").alias("h"))
    hits = staged(_sifted(hashed.select("_digest", F.size("_hashes").alias("size"), F.explode("_hashes").alias("h")), index), "hits")
    hits = _dealt(hits, index).where("least <= size").select("_digest", "item", "need", "h").distinct()
    found = staged(hits.groupBy("_digest", "item").agg(F.count("*").alias("n_hits"), F.first("need").alias("need")).where("n_hits >= need").select("_digest", "item"), "candidates")
    # every shingle of a candidate's item against those of the text that may be asked for; both sides are dealt by text and shingle
    asked = staged(found.join(items.select("item", F.explode("shingles").alias("s")), "item"), "asked")
    texts = bound(rows.join(found.select("_digest").distinct(), "_digest").select("_digest", text), "_words", words_of(F.lower(F.col(text))))
    there = reduce(DataFrame.unionByName, [texts.where(F.size("_words") >= k).select("_digest", F.explode(F.expr(
        f"transform(sequence(0, size(_words) - {k}), i -> concat(' ', array_join(slice(_words, i + 1, {k}), ' '), ' '))")).alias("s")) for k in lengths])
    pair = F.xxhash64("_digest", "s").alias("h")
    there = _sifted(there.select("*", pair), asked.select(pair)).drop("h").distinct()
    counts = asked.join(there, ["_digest", "s"]).groupBy("_digest", "item").agg(F.count("*").cast("int").alias("n_shared"))
    leaks = counts.join(items.select("item", "item_id", F.col("n").alias("n_item")), "item").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    leaks = staged(leaks.groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("item_id", "n_item", "n_shared"))).alias("_found")), "leaks")
    return rows.join(leaks, "_digest", "left").withColumn("_leaks", F.coalesce("_found", F.array().cast(kind))).drop("_digest", "_found")


def _with_leaks(rows: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, shingle: int, percent: int, block: int, item_words: int, least_words: int) -> DataFrame:
    items = staged(benchmark_items(benchmark, item_id=item_id, text=item_text, shingle=shingle, percent=percent).where(F.col("n_words") >= least_words), "items")
    kind = f"array<struct<item_id:{items.schema['item_id'].dataType.simpleString()},n_item:int,n_shared:int>>"
    n_items, n_words = items.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    if not n_items:
        return rows.withColumn("_leaks", F.array().cast(kind))
    return (_by_one_row if n_items <= block and n_words <= item_words else _by_index)(rows, items, text, percent, kind)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT, block: int = BLOCK, item_words: int = ITEM_WORDS, least_words: int = 1) -> DataFrame:
    """``docs`` with array ``leaks`` of (item_id, n_item, n_shared): the items that a document contains.

    An item is contained if at least ``percent`` hundredths of its distinct shingles are in the document.
    Items of fewer words than ``least_words`` are left out. Words are lower-cased. Null and empty texts
    contain nothing; an empty benchmark leaks nothing. A column named leaks is replaced, in any case of
    letters; all others pass through. Repeated rows stay. Ties don't arise: every item that reaches the
    limit is listed, by id; equal items each for itself. Ids may be of any type that sorts.
    """
    rows, names = renamed(docs)
    found = _with_leaks(rows, benchmark, next(new for new, old in names.items() if old == text), item_id, item_text, shingle, percent, block, item_words, least_words)
    return found.select(*restored(names, ("leaks",)), F.col("_leaks").alias("leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT, block: int = BLOCK, item_words: int = ITEM_WORDS, least_words: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that contain a test item; other rows and all columns stay as they are.

    Items of fewer than ``least_words`` words, which ordinary text may have by chance, drop nothing.
    """
    rows, names = renamed(docs)
    found = _with_leaks(rows, benchmark, next(new for new, old in names.items() if old == text), item_id, item_text, shingle, percent, block, item_words, least_words)
    return found.where(F.size("_leaks") == 0).select(*restored(names))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) for every document and each test item that it contains."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", F.explode_outer("leaks").alias("leak")).where("leak is not null").select(
        "doc_id", "leak.item_id", F.col("leak.n_item").cast("long").alias("n_item_shingles"), F.col("leak.n_shared").cast("long").alias("n_shared"))


#: Containment of every item in every document by counting shared shingles.
OP4_SQL = r"""
with iw as (select item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from benchmark),
ik as (select item_id, w, least(len(w), 5) as k from iw where len(w) > 0),
s as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as sh from ik),
n as (select item_id, count(*) as n from s group by item_id),
dw as (select doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents where text is not null),
d as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as sh
      from dw, (select distinct k from ik) ks where len(w) >= k)
select doc_id, item_id, n as n_item_shingles, count(*) as n_shared from d join s using (k, sh) join n using (item_id)
group by doc_id, item_id, n having count(*) * 100 >= n * 80
"""
