"""Importance resampling towards a target distribution, over a sparse count matrix in CSR blocks.

1. Words are hashed into buckets, runs of 1 to ``runs`` words each a feature. The counts of documents by
   bucket are written once to the shared folder as CSR blocks of up to ``BLOCK`` entries: ids, row starts,
   bucket numbers and counts, so no later step reads a text.
2. Column sums of the blocks are the distribution of the documents; the same of the target's texts. A
   bucket's gain is the scaled, rounded-down log ratio of the two smoothed shares.
3. A sparse matrix-vector product of each block with the gains gives the documents' weights.
4. A Gumbel number from a hash of the id is added, and the highest scores are drawn: sampling without
   replacement in proportion to the weights' exponentials. Places are counted by range partitions.

Gains are one long a bucket; only they, never rows, pass through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import read_table, staged
from tilewright.shared import numbered

BUCKETS = 10_000
RUNS = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
BLOCK = 500_000
#: Runs whose buckets a task remembers.
KNOWN = 300_000
#: Letters, digits and all bytes of non-ASCII characters are in words; A-Z are lower-cased.
_WORDS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
_BLOCKS = "ids binary, lengths binary, starts binary, buckets binary, counts binary"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def runs_of(words: list[bytes], runs: int) -> Iterator[bytes]:
    """All runs of 1 to ``runs`` words."""
    yield from words
    for size in range(2, runs + 1):
        for at in range(len(words) - size + 1):
            yield b" ".join(words[at: at + size])


def count_blocks(texts: DataFrame, *, runs: int = RUNS, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """CSR blocks of (row, text) rows: rows' numbers, words, starts, and the buckets and counts of all of them, each as one packed array.

    A null text has no words. A row is never split: it has ``buckets`` entries at most.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, lengths, starts, entries, counts = [], [], [0], [], []

        def packed() -> pa.RecordBatch:
            arrays = [np.array(ids, np.int64), np.array(lengths, np.int64), np.array(starts, np.int64), np.array(entries, np.int32), np.array(counts, np.int64)]
            for x in (ids, lengths, entries, counts):
                x.clear()
            starts[:] = [0]
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["ids", "lengths", "starts", "buckets", "counts"])

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, found = words_of(text), Counter()
                for run, c in Counter(runs_of(words, runs)).items():
                    b = known.get(run)
                    if b is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        b = known[run] = zlib.crc32(run) % buckets
                    found[b] += c
                ids.append(row)
                lengths.append(len(words))
                entries += sorted(found)
                counts += [found[b] for b in sorted(found)]
                starts.append(len(entries))
                if len(entries) >= block or len(ids) >= block:
                    yield packed()
        if ids:
            yield packed()

    return texts.mapInArrow(make, _BLOCKS)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, c) of the buckets that occur."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(total, np.frombuffer(b, np.int32), np.frombuffer(c, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "c"])

    return blocks.select("buckets", "counts").mapInArrow(add, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from two tables of (bucket, c)."""
    both = source.select("bucket", F.col("c").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("c").alias("t")))
    both = both.unionByName(source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    both = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = both.agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"))  # one row
    ratio = F.expr(f"(t + 1d) * (ss + {buckets}d) / ((s + 1d) * (tt + {buckets}d))")
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, n_words, n_features, weight): the product of the blocks with ``gain``."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, counts = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["counts"], np.int64)
                running = np.concatenate([[0], np.cumsum(counts * gain[np.frombuffer(row["buckets"], np.int32)])])
                features = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(np.frombuffer(row["lengths"], np.int64)), pa.array(np.diff(features[starts])), pa.array(np.diff(running[starts]))],
                                                 ["row", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "row bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``, drawn to be like ``target``'s texts.

    weight is the sum of gains over a document's features, 0 for none. rank counts from 1 over the
    ``percent`` hundredths (rounded down) of the documents of ``least_words`` words or more with the highest
    scores, ties to the smaller id; it is null for all others. Rows with a null id count in the
    distribution but have no score and are never drawn. Repeated rows are drawn one by one. Ids that
    aren't whole numbers work too. Empty tables give equal shares.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    ids = None
    if not whole or not docs.where("doc_id is null").isEmpty():
        # blocks hold longs: other ids, and null, are numbered first
        ids = staged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "resample-rows")
        docs, ids = ids.select("row", "text"), ids.select("row", "doc_id")
    else:
        docs = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    blocks = staged(count_blocks(docs, runs=runs, buckets=buckets), "count-blocks")
    wanted = count_blocks(target.select(F.lit(0).cast("long").alias("row"), F.col(f"`{text}`").alias("text")), runs=runs, buckets=buckets)
    found = gains(column_sums(blocks, buckets), column_sums(wanted, buckets), buckets).toArrow()
    gain = np.zeros(buckets, np.int64)
    gain[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    rows = weights(blocks, gain)
    rows = rows.withColumnRenamed("row", "doc_id") if ids is None else rows.join(ids, "row").drop("row")
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((uniform + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = staged(rows.withColumn("score", F.col("weight") + gumbel), "scores")
    open_ = rows.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    drawn = open_.count() * percent // 100
    placed = numbered(open_.select("doc_id", F.col("n_features"), "weight", "score", (-F.col("score")).alias("falling")), ["falling", "doc_id"], "place")
    kept = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    rest = rows.where((F.col("n_words") < least_words) | F.col("doc_id").isNull()).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return kept.unionByName(rest)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weights towards the texts of ``benchmark``, and the places of the tenth that is drawn."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same from all words; crc32 by its bits, eight steps a byte.
OP13_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
dw as (select doc_id, x, count(*) as c from (select doc_id, unnest(ws) as x from w) group by 1, 2),
bw as (select x, count(*) as c from (select unnest(ws) as x from b) group by 1),
hexed as (select x, hex(encode(x)) as hx from (select x from dw union select x from bw)),
bits as (select x, list_transform(range(0, 4 * length(hx)), lambda i: case when i % 8 = 0 then 16 * (strpos('0123456789ABCDEF', hx[i // 4 + 1]) - 1) + strpos('0123456789ABCDEF', hx[i // 4 + 2]) - 1 else 0 end::bigint) as steps from hexed),
placed_at as (select x, xor(list_reduce(steps, lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket from bits),
s as (select bucket, sum(c)::bigint as s from dw join placed_at using (x) group by 1),
t as (select bucket, sum(c)::bigint as t from bw join placed_at using (x) group by 1),
total as (select (select coalesce(sum(s), 0) from s)::double as ss, (select coalesce(sum(t), 0) from t)::double as tt),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::bigint as gain from s full join t using (bucket), total),
weight as (select doc_id, sum(c * gain)::bigint as weight from dw join placed_at using (x) join gain using (bucket) group by 1),
digits as (select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
  list_reduce(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1)::bigint), lambda a, v: 16 * a + v) as h from w left join weight using (doc_id)),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from digits),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= (select 10 * count(*) // 100 from placed) then place end as rank from scored left join placed using (doc_id)
"""
