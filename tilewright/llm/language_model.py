"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Counts of all training words come from one aggregation. Words are grouped into at most ``SINGLES`` +
``SUFFIXES`` + 1 classes: the commonest words and the end are a class each, all others go by their last
three bytes. The model (Mnih and Hinton's log-bilinear form) predicts a class from the two classes
before it: q = R[h1] C1 + R[h2] C2, score(w | h) = q . Q[w] + b[w]. A word inside a class of several has
its smoothed share of the class. Probabilities add up to one over all words and one unknown word
per class.

Training covers every training text. The texts fall by hash into rounds of rising size; in a round each
task goes through its texts with its own copy of the parameters (minibatches, noise shared by a batch,
Adagrad), and the copies are averaged by blocks of parameters, weighted by tokens. So parameters depend
on how the texts fall into partitions. They have a fixed size, whatever the corpus.

Scoring: with E1 = exp(R C1 Q') and E2 = exp(R C2 Q' + b), one matrix product E1 E2' has the normaliser
of every context, so a token's normalised log-probability is four table lookups.

Words of at least a share of ``FREQUENT`` of all training tokens (1 / FREQUENT at most) are known to every
task; the counts of all others meet the texts by a join, pre-aggregated per text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import held_out, read_table, staged

ALPHA = 0.1
FREQUENT = 2e-5
SINGLES = 767
SUFFIXES = 255
#: Suffix classes have at least this share of all training tokens.
SUFFIX_SHARE = 5e-4
DIMENSIONS = 16
NOISE = 128
BATCH = 4096
RATE = 0.08
#: Sixteenths of the training texts in each round.
ROUNDS = ((0, 1), (1, 4), (4, 16))
BLOCK_ROWS = 128
#: Words of a task that are counted before they are passed on.
COUNTED = 300_000
END = b"\n"


def words_in(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split knows the white space of the contract and no other."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): words and ends of all texts of ``docs``; null texts are empty."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_in(text))
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    return docs.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the words: frequent words with counts, and classes."""

    tokens: int
    types: int
    words: dict[bytes, int]  # frequent word -> place in the arrays below
    counts: np.ndarray
    classes: np.ndarray
    suffixes: dict[bytes, int]
    class_tokens: np.ndarray
    class_types: np.ndarray  # 0 for classes of one word
    other: int = field(default=0)

    @property
    def end(self) -> int:
        return 0

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places among the frequent words (-1: none) and classes."""
        get, suffix, other = self.words.get, self.suffixes.get, self.other
        places = np.array([get(w, -1) for w in words], np.int64)
        classes = self.classes[places]
        missing = np.flatnonzero(places < 0)
        if len(missing):
            classes[missing] = [suffix(words[k][-3:], other) for k in missing.tolist()]
        return places, classes


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, n); an empty table knows only the end."""
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = [(bytes(r.word), r.n) for r in counts.where(F.col("n") >= F.lit(FREQUENT * tokens)).collect()]
    frequent = sorted([x for x in frequent if x[0] != END], key=lambda x: (-x[1], x[0]))
    end = counts.where(F.col("word") == F.lit(bytearray(END))).first()
    frequent = [(END, end.n if end else 0), *frequent]
    singles = len(frequent[: SINGLES + 1])
    alone = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in frequent[:singles]], "alone binary")
    rest = counts.join(F.broadcast(alone), F.col("word") == F.col("alone"), "left_anti").groupBy(F.expr("substring(word, greatest(length(word) - 2, 1), 3)").alias("suffix")).agg(
        F.sum("n").alias("n"), F.count("*").alias("types"))
    rest = staged(rest, "suffixes")
    all_n, all_types = rest.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    top = sorted(((r.n, bytes(r.suffix), r.types) for r in rest.where(F.col("n") >= F.lit(SUFFIX_SHARE * tokens)).collect()), key=lambda x: (-x[0], x[1]))[:SUFFIXES]
    suffixes = {s: singles + k for k, (_, s, _) in enumerate(top)}
    other = singles + len(top)
    class_tokens = np.array([n for _, n in frequent[:singles]] + [n for n, _, _ in top] + [all_n - sum(x[0] for x in top)], float)
    class_types = np.array([0] * singles + [t for _, _, t in top] + [all_types - sum(x[2] for x in top)], float)
    classes = np.array([k if k < singles else suffixes.get(w[-3:], other) for k, (w, _) in enumerate(frequent)] + [other], np.int64)
    return Vocabulary(tokens, types, {w: k for k, (w, _) in enumerate(frequent)}, np.array([n for _, n in frequent] + [0], float), classes, suffixes, class_tokens, class_types, other)


def start_parameters(vocabulary: Vocabulary, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Small fixed random vectors; biases are the smoothed log shares of the classes."""
    k = len(vocabulary.class_tokens)
    rng = np.random.default_rng(7)
    share = (vocabulary.class_tokens + ALPHA) / (vocabulary.class_tokens + ALPHA).sum()
    eye = np.eye(dimensions, dtype=np.float32)
    return {"R": rng.normal(0, 0.3, (k, dimensions)).astype(np.float32), "Q": rng.normal(0, 0.1, (k, dimensions)).astype(np.float32),
            "C1": eye.copy(), "C2": 0.5 * eye, "b": np.log(share).astype(np.float32)[:, None]}


def contexts(classes: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class before each token and the one before that; ``end`` stands before a text's first token."""
    one = np.roll(classes, 1)
    two = np.roll(classes, 2)
    one[starts] = end
    two[starts] = end
    second = starts + 1
    two[second[second < len(two)]] = end
    return one, two


class Trainer:
    """Noise-contrastive estimation on batches of (class, class before, the one before that)."""

    def __init__(self, parameters: dict[str, np.ndarray], noise_share: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.seen = {k: np.full_like(v, 1e-3) for k, v in parameters.items()}
        self.share, self.total = noise_share, noise_share.cumsum()
        self.log_noise = np.log(noise_share * NOISE).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, n = self.p, len(w)
        noise = np.minimum(np.searchsorted(self.total, (np.arange(NOISE) + self.rng.random()) * (self.total[-1] / NOISE)), len(self.total) - 1)
        r1, r2 = p["R"][one], p["R"][two]
        q = r1 @ p["C1"] + r2 @ p["C2"]
        qw, qn = p["Q"][w], p["Q"][noise]
        good = (q * qw).sum(axis=1) + p["b"][w, 0] - self.log_noise[w]
        bad = q @ qn.T + (p["b"][noise, 0] - self.log_noise[noise])
        g = 1 / (1 + np.exp(np.minimum(good, 80)))  # 1 - sigmoid
        np.minimum(bad, 80, out=bad)
        np.negative(bad, out=bad)
        np.minimum(bad, 80, out=bad)
        h = np.exp(bad, out=bad)
        h += 1
        np.divide(-1, h, out=h)  # -sigmoid
        dq = g[:, None] * qw + h @ qn
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        self._add(grads["Q"], w, g[:, None] * q)
        np.add.at(grads["Q"], noise, h.T @ q)
        grads["b"][:, 0] = np.bincount(w, g, len(p["b"])) + np.bincount(noise, h.sum(axis=0), len(p["b"]))
        self._add(grads["R"], one, dq @ p["C1"].T)
        self._add(grads["R"], two, dq @ p["C2"].T)
        grads["C1"], grads["C2"] = r1.T @ dq, r2.T @ dq
        for k, grad in grads.items():
            grad /= np.float32(math.sqrt(n))
            self.seen[k] += grad * grad
            p[k] += np.float32(RATE) * grad / np.sqrt(self.seen[k])

    @staticmethod
    def _add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def _in_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, column: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, starts of texts) of about ``size`` tokens; a text is never split from its end."""
    classes, starts, n = [], [], 0
    for batch in batches:
        for text in batch.column(column).to_pylist():
            own = vocabulary.lookup([*words_in(text), END])[1]
            starts.append(n)
            classes.append(own)
            n += len(own)
            if n >= size:
                yield np.concatenate(classes), np.array(starts)
                classes, starts, n = [], [], 0
    if n:
        yield np.concatenate(classes), np.array(starts)


def train(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters after all rounds over every text of ``docs`` (column text)."""
    spark = docs.sparkSession
    parameters = start_parameters(vocabulary)
    share = (vocabulary.class_tokens + 1) / (vocabulary.class_tokens + 1).sum()
    known = spark.sparkContext.broadcast(vocabulary)
    hashed = docs.select("text", F.pmod(F.xxhash64("text", F.lit("round")), F.lit(16)).alias("part"))
    for number, (low, high) in enumerate(ROUNDS):
        sent = spark.sparkContext.broadcast(parameters)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, tokens = Trainer(sent.value, share, 100 + number), 0
            for classes, starts in _in_batches(batches, known.value, 0, 8 * BATCH):
                one, two = contexts(classes, starts, known.value.end)
                order = trainer.rng.permutation(len(classes))
                for at in range(0, len(order), BATCH):
                    chosen = order[at: at + BATCH]
                    trainer.step(classes[chosen], one[chosen], two[chosen])
                tokens += len(classes)
            for name, value in trainer.p.items() if tokens else ():
                for at in range(0, len(value), BLOCK_ROWS):
                    part = value[at: at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}:{at}"]), pa.array([tokens], pa.int64()), pa.array([part.astype(np.float64).ravel().tolist()], pa.list_(pa.float64()))], ["block", "tokens", "value"])

        copies = hashed.where((F.col("part") >= low) & (F.col("part") < high)).select("text").mapInArrow(learn, "block string, tokens bigint, value array<double>")
        weighed = copies.select("block", "tokens", F.posexplode("value").alias("k", "v")).groupBy("block", "k").agg((F.sum(F.col("v") * F.col("tokens")) / F.sum("tokens")).alias("v"))
        for r in weighed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("v")).collect():
            name, at = r.block.split(":")
            value = np.array([x.v for x in r.v], np.float32).reshape(-1, parameters[name].shape[1])
            parameters[name] = parameters[name].copy()
            parameters[name][int(at): int(at) + len(value)] = value
        sent.unpersist()
    return parameters


class Tables:
    """Normalised log10 probabilities of classes."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.one = (p["R"] @ p["C1"]) @ p["Q"].T
        self.two = (p["R"] @ p["C2"]) @ p["Q"].T
        self.bias = p["b"][:, 0]
        self.norm = np.log(np.exp(self.one) @ np.exp(self.two + self.bias).T)

    def __call__(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (self.one[one, w] + self.two[two, w] + self.bias[w] - self.norm[one, two]).astype(np.float64) / math.log(10)


@lru_cache(maxsize=1)
def _tables(key: bytes) -> Tables:
    import pickle

    return Tables(pickle.loads(key))


_SCORED = "row bigint, doc_id {}, n_tokens bigint, n_known bigint, base double, model double, rare array<struct<word:binary,n:bigint>>"


def score_texts(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, parameters: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of (doc_id, text), from whole texts."""
    import pickle

    spark = docs.sparkSession
    known, key = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(pickle.dumps(parameters))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tables = known.value, _tables(key.value)
        row = TaskContext.get().partitionId() << 33
        log_count = np.log10(v.counts + ALPHA)
        several = v.class_types > 0
        several[v.other] = True  # it has the unknown words even if no known one
        log_size = np.where(several, np.log10(v.class_tokens + ALPHA * (v.class_types + 1)), 0.0)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                places, classes, starts, n = [], [], [], 0
                rare, times, bounds = [], [], [0]
                for text in batch.column(1).to_pylist():
                    words = [*words_in(text), END]
                    p, c = v.lookup(words)
                    starts.append(n)
                    places.append(p), classes.append(c)
                    n += len(words)
                    seen = Counter([words[k] for k in np.flatnonzero(p < 0).tolist()])
                    rare += seen
                    times += seen.values()
                    bounds.append(len(rare))
                p, c, first = np.concatenate(places), np.concatenate(classes), np.array(starts)
                one, two = contexts(c, first, v.end)
                entries = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                base = log_count[p] * (p >= 0)
                model = tables(c, one, two) - log_size[c] + base * several[c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(batch)), pa.int64()), batch.column(0), pa.array(np.diff(np.r_[first, n]), pa.int64()), pa.array(np.add.reduceat(((p >= 0) & (v.counts[p] > 0)).astype(np.int64), first)),
                     pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries)], ["row", "doc_id", "n_tokens", "n_known", "base", "model", "rare"])
                row += len(batch)

    scored = staged(docs.select("doc_id", "text").mapInArrow(score, _SCORED.format(docs.schema["doc_id"].dataType.simpleString())), "scored")
    words = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("rare"), F.col("r.n").alias("times"))
    found = words.join(counts, F.col("rare") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    total = math.log10(vocabulary.tokens + ALPHA * (vocabulary.types + 1))
    return scored.drop("rare").join(found.withColumnRenamed("row", "f_row"), F.col("row") == F.col("f_row"), "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("model") + F.coalesce("rare_log", F.lit(0.0))).alias("score"))


def fit_and_score(docs: DataFrame, training: DataFrame) -> tuple[DataFrame, Vocabulary, dict[str, np.ndarray]]:
    """Scores of ``docs`` (doc_id, text) under the model learned from ``training`` (text).

    Null texts are empty: one token, the end. Without training texts every text scores by the smoothing
    alone. Repeated rows stay; null ids pass through.
    """
    training = training.select("text")
    counts = staged(count_words(training), "word-counts")
    vocabulary = learn_vocabulary(counts)
    parameters = train(training, vocabulary)
    return score_texts(docs, counts, vocabulary, parameters), vocabulary, parameters


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text; texts with crc32(doc_id) mod 10 = 0 are held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scores, vocabulary, _ = fit_and_score(docs, docs.where(~held_out(F.col("doc_id"), 10, 0)))
    return scores.select("doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
