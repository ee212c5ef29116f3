"""MinHash near-duplicates with odd sketches, exact confirmation on full shingle sets, and components.

1. One pass over the texts gives each document the number of its word shingles, a key of their set,
   ``SAMPLES`` or more MinHash values, band hashes of the first of them and an odd sketch: the MinHash
   samples fold into a parity bitmap, so two documents' bitmaps differ in about as many bits as their
   samples do. Documents with equal sets collapse to one node, named by its smallest id.
2. Bands of ``ROWS`` values, so many that a pair at the limit meets in none of them once in 10^6.
   Buckets with the same members in several bands count once. Members of a bucket are dealt into blocks of
   about ``BLOCK``; the XOR population counts of the odd sketches tell which members of a block are likely
   links. Components of the likely links, with all blocks of a bucket as one, are clusters: every link is
   inside one, and a node is in one only. Up to here only sketches are shuffled.
3. The sets of nodes in clusters are confirmed exactly, cluster by cluster. A large cluster is dealt into
   blocks of about ``BLOCK`` nodes and ``BLOCK_BYTES`` of sets, which share the cluster's ``PIVOTS`` smallest nodes. A
   block gives back a star per component that it has found, never its pairs.
4. Components of all stars by alternating large-star and small-star steps.
5. In large clusters every node outside the cluster's largest component meets the other blocks, first by
   sketches, then the likely ones by their sets.

Nothing is dropped or capped: a large cluster only has more blocks. A huge group of copies stays linear in
its size, as its members need no comparison once they share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import read_table, renamed, restored, row_hash, staged

SHINGLE = 5
THRESHOLD_PERCENT = 80
ROWS = 5
MISS = 1e-6
SAMPLES = 256
SKETCH_BITS = 1024
BLOCK = 96
BLOCK_BYTES = 32_000_000
PIVOTS = 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of up to ``keep`` words."""

    def __init__(self, size: int, keep: int = 200_000):
        self.size, self.keep, self.known = size, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles; of all its words if it has fewer than ``size``."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        try:
            hashes = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.array([known[w] for w in words], np.uint64)
        n = len(hashes)
        if n < self.size:
            out = np.array([n], np.uint64)
            for h in hashes:
                out = _mix(out * _M3 + h)
            return out
        out = hashes[: n - self.size + 1]
        for j in range(1, self.size):
            out = _mix(out * _M3) + hashes[j: n - self.size + 1 + j]
        return np.unique(_mix(out))


@lru_cache(maxsize=4)
def _hash_family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _M3)
    return seeds[:samples] | np.uint64(1), seeds[samples:]


def minhash(shingles: np.ndarray, samples: int) -> np.ndarray:
    """``samples`` MinHash values (32 bits) of a set that isn't empty."""
    a, b = _hash_family(samples)
    least = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at: at + 512, None] * a + b).min(axis=0), out=least)
    return least >> np.uint64(32)


def odd_sketch(values: np.ndarray, bits: int) -> bytes:
    """Parity bitmap of the samples, each with its place."""
    places = _mix(values * _M3 + np.arange(len(values), dtype=np.uint64) * _M2) % np.uint64(bits)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands for a chance of ``miss`` at most that a pair at the threshold meets in none."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def most_differing_bits(threshold: float, samples: int, bits: int) -> int:
    """XOR population count that a pair at the threshold exceeds once in a million.

    At Jaccard J, m samples leave 2 m (1 - J) odd places before folding; five standard deviations of
    the samples and of the bitmap together are added to the count expected at the threshold.
    """
    differ = 2 * samples * (1 - threshold)
    stay = math.exp(-2 * differ / bits)
    by_samples = 2 * math.sqrt(samples * threshold * (1 - threshold)) * stay
    by_bitmap = math.sqrt(bits * (1 - stay * stay)) / 2
    return min(bits, math.ceil(bits / 2 * (1 - stay) + 5 * math.hypot(by_samples, by_bitmap)))


_SIGNATURES = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary"


def signatures(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """_SIGNATURES per row of (doc_id, text); without words: no shingles, null key, bands and sketch."""
    bands, rows = n_bands(threshold), ROWS
    samples = max(SAMPLES, bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _M2)
        for batch in batches:
            sizes, keys, bucket, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), bucket.append(None), sketches.append(None)
                    continue
                values = minhash(s, samples)
                h = salt.copy()
                for j in range(rows):
                    h = _mix(h * _M3 + values[j: bands * rows: rows])
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bucket.append(h.view(np.int64))
                sketches.append(odd_sketch(values, SKETCH_BITS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bucket, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                                             ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.mapInArrow(sign, _SIGNATURES)


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, set_key, sketch, cluster, block, blocks, shingles) of the rows of (node, text, set_key, sketch, cluster, block, blocks) whose text has the set of that key."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler(t).tobytes() for t in batch.column(1).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(2).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sets, pa.binary())], ["node", "set_key", "sketch", "cluster", "block", "blocks", "shingles"]).filter(same)

    return docs.mapInArrow(cut, "node bigint, set_key binary, sketch binary, cluster bigint, block int, blocks int, shingles binary")


def _popcounts(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ one).sum(axis=1, dtype=np.int32)


def _partners(i: int, labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, open_: np.ndarray, percent: int, most_bits: int) -> np.ndarray:
    """Rows of ``open_`` with another label that are likely partners of row i by size and sketch, the most likely first."""
    small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
    rest = np.flatnonzero(open_ & (labels != labels[i]) & (100 * small >= percent * large))
    bits = _popcounts(sketches[i], sketches[rest])
    order = np.argsort(bits, kind="stable")
    return rest[order[: np.count_nonzero(bits <= most_bits)]]


def _likely(labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, asks: np.ndarray, percent: int, most_bits: int) -> np.ndarray:
    """The rows of a block that have a likely partner: among all rows if all ask, else among askers and those that don't."""
    found = np.zeros(len(labels), bool)
    rest = np.ones(len(labels), bool) if asks.all() else ~asks
    for i in np.flatnonzero(asks):
        with_ = _partners(i, labels, sizes, sketches, rest, percent, most_bits)
        if len(with_):
            found[i] = True
            found[with_] = True
    return found


def _links(nodes: np.ndarray, labels: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, percent: int, most_bits: int) -> list[tuple[int, int]]:
    """Confirmed links that join the rows of a block; rows of one label are joined already.

    asks: the rows to compare with all others, or, if not all rows ask, with all that don't.
    """
    out, labels = [], np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    open_ = np.ones(len(nodes), bool) if asks.all() else ~asks
    for i in np.flatnonzero(asks):
        open_[i] = False
        for j in _partners(i, labels, sizes, sketches, open_, percent, most_bits):
            if labels[j] == labels[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                out.append((int(nodes[i]), int(nodes[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components as (smallest node, other node)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(root(x), x) for x in up if root(x) != x]


def _most_bits(percent: int) -> int:
    return most_differing_bits(percent / 100, max(SAMPLES, n_bands(percent / 100) * ROWS), SKETCH_BITS)


def _sketches(table: pa.Table, order: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(order), -1)[order]


def _likely_stars(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) stars of the likely links in the groups of ``members``: bucket, block, node, n_shingles, sketch."""
    most = _most_bits(percent)

    def group(table: pa.Table) -> pa.Table:
        nodes, sizes = table["node"].to_numpy(), table["n_shingles"].to_numpy()
        sketches, labels = _sketches(table, np.arange(len(table))), np.arange(len(table))
        for i in range(len(nodes)):
            found = _partners(i, labels, sizes, sketches, np.ones(len(nodes), bool), percent, most)
            labels[np.isin(labels, labels[found])] = labels[i]
        least = {int(k): int(nodes[labels == k].min()) for k in np.unique(labels)}
        pairs = [(least[int(k)], int(x)) for k, x in zip(labels, nodes) if least[int(k)] != x]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return members.groupBy("bucket", "block").applyInArrow(group, "a bigint, b bigint")


def _with_partners(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """keys, node and asks of the ``members`` (keys, node, label, n_shingles, sketch, asks) that have a likely partner of another label in their group."""
    most = _most_bits(percent)
    schema = ", ".join([f"{k} {dict(members.dtypes)[k]}" for k in keys] + ["node bigint", "asks boolean"])

    def group(table: pa.Table) -> pa.Table:
        order = np.arange(len(table))
        asks = table["asks"].to_numpy(zero_copy_only=False)
        found = _likely(table["label"].to_numpy(), table["n_shingles"].to_numpy(), _sketches(table, order), asks, percent, most)
        return table.select([*keys, "node", "asks"]).filter(pa.array(found))

    return members.groupBy(*keys).applyInArrow(group, schema)


def _compare(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b) stars from the groups of ``members``: keys, node, label, sketch, shingles, asks."""
    most = _most_bits(percent)

    def group(table: pa.Table) -> pa.Table:
        nodes, labels = table["node"].to_numpy(), table["label"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        raw = table["shingles"].to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        found = _stars(_links(nodes[order], labels[order], _sketches(table, order), sets, table["asks"].to_numpy(zero_copy_only=False)[order], percent, most))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return members.groupBy(*keys).applyInArrow(group, "a bigint, b bigint")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its component."""
    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def settled(e: DataFrame) -> bool:
        """Whether all edges (a < b) are stars: no b is an a, or a b twice."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("root"), F.lit(0).alias("leaf")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("root"), F.lit(1).alias("leaf")))
        return ends.groupBy("n").agg(F.max("root").alias("root"), F.sum("leaf").alias("leaves")).where("leaves > 1 or leaves = 1 and root = 1").isEmpty()

    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = 0
    while not settled(edges):
        if rounds == max_rounds:
            raise RuntimeError("components don't settle")
        rounds += 1
        # large star: every larger neighbour of a node links to the node's least neighbour
        pairs = both_ways(edges)
        # both sides of each join are plain tables, so that Spark can split the edges of a node that thousands link to
        least = staged(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n"), "least")
        large = pairs.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = staged(large, "large-star")
        # small star: every smaller neighbour of a node, and the node, link to the least of them
        least = staged(large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n"), "least")
        small = large.join(least, F.col("b") == F.col("n"))
        edges = staged(small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(), "edges")
    return staged(edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()), name)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (doc_id, text) with bigint ids in the order of those given, and (number, id) where they aren't whole numbers."""
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), None
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct().orderBy("id")
    ids = staged(ids.select(F.monotonically_increasing_id().alias("number"), "id"), "ids")
    return docs.join(ids, F.col("doc_id") == F.col("id"), "left").select(F.col("number").alias("doc_id"), "text"), ids


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Two documents are linked if their sets' intersection is at least ``percent`` hundredths of their union.
    component_id is the smallest doc_id that links reach. Texts without words are linked with nothing.
    Rows with the same doc_id are one node, with the links of all their texts. Rows with a null id stay alone: their component is null and
    they are kept. Repeated rows stay, kept alike. Ids may be of any type that sorts.
    """
    docs, ids = _numbered(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    signed = staged(signatures(docs, shingle, percent / 100), "signatures")
    named = signed.where("set_key is not null and doc_id is not null")
    unique = staged(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sets")
    same = named.select("doc_id", "set_key").join(unique.select("set_key", "node"), "set_key").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    # rows of one id may have several texts, so one node several sets: a set's own tag tells buckets apart and finds its sketch
    tagged = unique.select("node", "n_shingles", F.xxhash64("set_key").alias("tag"), "sketch", "bands")
    entries = tagged.select("node", "n_shingles", "tag", F.explode("bands").alias("bucket"))
    whole = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr("bit_xor(tag)").alias("mark"))
    whole = whole.where("n > 1").groupBy("n", "lo", "hi", "mark").agg(F.min("bucket").alias("bucket"))
    members = entries.join(whole.select("bucket", "lo", F.expr(f"cast(ceil(n / {block}) as int)").alias("blocks")), "bucket").select(
        "bucket", "node", "n_shingles", "tag", "lo", "blocks", F.expr("pmod(xxhash64(node, bucket), blocks)").cast("int").alias("block"))
    members = staged(members.join(tagged.select("tag", "sketch"), "tag"), "members")
    likely = _likely_stars(members.select("bucket", "block", "node", "n_shingles", "sketch"), percent)
    clusters = components(likely.unionByName(members.where("blocks > 1 and node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))), "clusters")
    sizes = clusters.join(unique.select("node", "n_shingles"), "node").groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).select(
        F.col("label").alias("cluster"), F.expr(f"cast(ceil(greatest(n / {block}, 8 * total / {block_bytes})) as int)").alias("blocks"))
    # ids and sets grow with the documents: never broadcast, at any size
    dealt = staged(clusters.join(sizes, F.col("label") == F.col("cluster")).select(
        "cluster", "node", "blocks", F.expr("pmod(xxhash64(node, 5), blocks)").cast("int").alias("block")), "dealt")
    keys = unique.select("node", "set_key", "sketch").join(dealt, "node")
    full = _shingle_sets(docs.hint("merge").join(keys, F.col("doc_id") == F.col("node")).select("node", "text", "set_key", "sketch", "cluster", "block", "blocks"), shingle)
    if not named.groupBy("doc_id", "set_key").count().where("count > 1").isEmpty():
        full = full.dropDuplicates(["node", "set_key"])
    full = staged(full, "full-sets")
    row = ["cluster", "block", "node", F.col("node").alias("label"), "sketch", "shingles", F.lit(True).alias("asks")]
    first = full.select(*row)
    large = dealt.where("blocks > 1")
    any_large = not large.isEmpty()
    if any_large:
        lowest = Window.partitionBy("cluster").orderBy("node")
        pivots = large.withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= PIVOTS).select("node", F.col("block").alias("home"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("at")).where("at <> home")
        first = first.unionByName(full.where("blocks > 1").drop("block").join(pivots.select("node", F.col("at").alias("block")), "node").select(*row))
    stars = staged(_compare(first, ["cluster", "block"], percent), "stars")
    joined = components(stars.unionByName(same), "components")
    if any_large:
        between = _between_blocks(_labelled(large.join(unique.select("node", "n_shingles", "sketch"), "node"), joined), block)
        group = ["cluster", "from", "block"]
        again = _labelled(staged(_with_partners(between, group, percent), "across"), joined)
        if not again.isEmpty():
            stars = staged(_compare(again.join(full.select("node", "sketch", "shingles"), "node"), group, percent), "more-stars")
            joined = components(joined.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(stars), "components")
    labels = joined.select(F.col("node").alias("l_node"), F.col("label"))
    out = signed.join(labels, F.col("doc_id") == F.col("l_node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    if ids is not None:
        for name in ("doc_id", "component_id"):
            out = out.join(ids.withColumnRenamed("id", "given"), F.col(name) == F.col("number"), "left").drop("number", name).withColumnRenamed("given", name)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _labelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with the component of their node as ``label``; a node that nothing is linked to is its own."""
    return rows.join(joined.withColumnRenamed("node", "j_node"), F.col("node") == F.col("j_node"), "left").withColumn("label", F.coalesce("label", "node")).drop("j_node")


def _between_blocks(large: DataFrame, block: int) -> DataFrame:
    """Rows of (cluster, from, block): nodes outside a cluster's largest component, in groups of about ``block``, ask each of its blocks but their own.

    Nodes of the largest component only answer, so a cluster of copies is read once for each group of others.
    """
    large = staged(large, "large")
    sizes = large.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("top"), (F.sum("c") - F.max("c")).alias("others"))
    sizes = sizes.where("others > 0").select("cluster", "top", F.expr(f"cast(ceil(others / {block}) as int)").alias("froms"))
    rows = staged(large.join(sizes, "cluster").select("cluster", "node", "label", "n_shingles", "sketch", "block", "blocks", "top", "froms"), "large-rows")
    row = ["cluster", "node", "label", "n_shingles", "sketch"]
    asks = rows.where("label <> top").select(*row, F.expr("pmod(xxhash64(node, 7), froms)").cast("int").alias("from"), F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> block)")).alias("block"), F.lit(True).alias("asks"))
    answers = rows.select(*row, F.explode(F.expr("sequence(0, froms - 1)")).alias("from"), "block", F.lit(False).alias("asks"))
    return asks.unionByName(answers)


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates: its smallest doc_id; of repeated rows of that id one.

    Rows with a null id stay, and of rows with texts without words all.
    """
    rows, names = renamed(docs)
    now = {old: new for new, old in names.items()}
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    out = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = rows.join(out, F.col(now[doc_id]) == F.col("_gone"), "left_anti")
    spaced = F.trim(F.translate(F.coalesce(F.col(now[text]), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    place = F.row_number().over(Window.partitionBy(now[doc_id]).orderBy(row_hash(rows)))
    return rows.withColumn("_place", F.when(F.col(now[doc_id]).isNull() | spaced, 1).otherwise(place)).where("_place = 1").select(*restored(names))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)


#: The same from all pairs that share a shingle, and everything that links reach.
OP7_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(1, len(ws) - 2) + 1), lambda i: array_to_string(ws[i:i + 2], ' '))) as sh from w where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (sh) where a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from shared join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
two as (select x, y from e union all select y, x from e),
r as (select x, y from two union select r.x, two.y from r join two on r.y = two.x)
select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, least(doc_id, coalesce(m, doc_id)) = doc_id as kept
from w left join n using (doc_id) left join (select x as doc_id, min(y) as m from r group by x) using (doc_id)
"""
