"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick in folded text.

Folding lower-cases, drops zero-width characters, maps homoglyphs of other scripts to Latin letters
and digits or signs inside words to the letters they stand for; all else between words becomes one
space. Lexicon entries are whole words or stems (word prefixes of 3 to 8 letters). Entries come from
a bounded sample of labelled rows (``SAMPLE`` rows with the smallest id hashes; equal texts count
once): candidates by document counts in toxic and clean rows, then a greedy cover of the toxic rows,
so that of entries for the same rows the most general one stays. An entry weighs its smoothed log
odds. Both counts are joined and filtered in Spark, so ``SAMPLE`` is the only bound. An exception phrase is a lexicon word with its left or right neighbour that clean rows have
twice or more and toxic rows never; its matches don't count.

A text's raw score is the sum of the weights of its matches; a logistic function of that sum, of the
same sum divided by the number of words, and of the length gives a score from 0 to 1.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import held_out, read_table, renamed, restored, staged

SAMPLE = 12_000
#: Patterns that a task counts before it sends the counts on.
COUNTED = 200_000
STEMS = range(3, 9)

#: Letters of other scripts and the Latin letters that they look like.
_HOMOGLYPHS = str.maketrans("авеёкмнорстухѕіјһԁԛԝαεικνορτυχ", "abeekmhopctyxsijhdqwaeikvoptux")
#: What stands for a letter inside a word.
_LEET = str.maketrans("013457@$!", "oieastasi")
_ZERO = re.compile("[­​-‏⁠﻿]")
_FOREIGN = re.compile("[Ͱ-ԯ！-～]")
_MIXED = re.compile(r"[^\W_]*(?:[^\W\d_][@$!]+(?=[^\W\d_])|[^\W\d_][0-9]+|[0-9]+[^\W\d_])[^\W_]*(?:[@$!]+[^\W_]+)*")
_LEET_SIGN = re.compile(r"[0-9]|[^\W\d_][@$!][^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")
_FULLWIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at both ends; one space for no words."""
    t = (text or "").lower()
    if not t.isascii():
        t = _ZERO.sub("", t)
        if _FOREIGN.search(t):
            t = t.translate(_FULLWIDTH).lower().translate(_HOMOGLYPHS)
    if _LEET_SIGN.search(t):
        t = _MIXED.sub(lambda m: m[0].translate(_LEET), t)
    words = _GAP.sub(" ", t).strip()
    return f" {words} " if words else " "


@dataclass
class Lexicon:
    """Entries by their pattern in folded text (`` word `` or `` stem``), exception phrases, logistic weights."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    logistic: tuple[float, float, float, float] = (-3.0, 1.0, 1.0, 0.0)

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            machine.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        if len(machine):
            machine.make_automaton()
        return machine

    def matches(self, machine, folded: str) -> dict[int, float]:
        """Word start -> the largest weight of an entry there, without words inside exception phrases."""
        if not len(machine):
            return {}
        hits, excused = {}, []
        for end, (length, weight) in machine.iter(folded):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, -math.inf))
        if not excused:
            return hits
        # phrases by their starts, and the furthest end of those begun so far: a word is excused if that lies behind it
        excused.sort()
        kept, at, reach = {}, 0, -1
        for s in sorted(hits):
            while at < len(excused) and excused[at][0] <= s:
                reach = max(reach, excused[at][1])
                at += 1
            if s >= reach:
                kept[s] = hits[s]
        return kept


def _features(raw: float, words: int) -> tuple[float, float, float]:
    return math.log1p(raw), math.log1p(100 * raw / max(words, 1)), math.log1p(words) / 10


def _patterns(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if len(w) >= k)
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pattern) of every text, in parts of about ``COUNTED`` rows."""
    for batch in batches:
        rows, found = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            own = _patterns(fold(text))
            rows += [k] * len(own)
            found += own
            if len(found) > COUNTED or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["doc_id", "pattern"])
                rows, found = [], []


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals = Counter()
    for batch in batches:
        for text in batch["text"]:
            totals.update(_patterns(fold(text)))
            if len(totals) > COUNTED:
                yield pd.DataFrame({"pattern": list(totals), "c": list(totals.values())})
                totals.clear()
    yield pd.DataFrame({"pattern": list(totals), "c": list(totals.values())})


def learn_lexicon(labelled: DataFrame, *, min_docs: int = 3) -> Lexicon:
    """Lexicon from (doc_id, text, toxic) rows.

    Rows with a null label or id are left out. Equal texts count once, as toxic if one of them is. Without toxic rows the lexicon is empty and every text
    scores alike.
    """
    chosen = labelled.where("toxic is not null and doc_id is not null").select("doc_id", "toxic", "text")
    chosen = staged(chosen.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxic-sample")
    toxic, clean = chosen.where("toxic = 1"), chosen.where("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic:
        return Lexicon()
    kind = chosen.schema["doc_id"].dataType.simpleString()
    pairs = staged(toxic.select("doc_id", "text").mapInArrow(_emit, f"doc_id {kind}, pattern string"), "toxic-patterns")
    common = pairs.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min(min_docs, max(1, n_toxic // 3)))
    found = clean.select("text").mapInPandas(_count, "pattern string, c bigint").groupBy("pattern").agg(F.sum("c").alias("c"))
    # precise entries only: at least four fifths of their rows are toxic, whatever share of the sample is
    both = common.join(found, "pattern", "left").select("pattern", "n", F.coalesce("c", F.lit(0)).alias("c")).where("n >= 4 * c")
    both = staged(both.where(F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1)) > 1), "toxic-strong")
    strong = both.collect()
    counts, in_clean = {r.pattern: r.n for r in strong}, {r.pattern: r.c for r in strong}
    odds = {p: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean[p] + 0.5) / (n_clean + 1)) for p, n in counts.items()}
    if not strong:
        return Lexicon()
    # of patterns with the same toxic rows only the first in the cover's order can be taken; so copies of a long text send each set of rows once
    rows = pairs.join(both.select("pattern", "c"), "pattern").groupBy("pattern", "c").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    first = F.min_by("pattern", F.struct("c", -F.length(F.trim("pattern")), "pattern"))
    docs_of = {r.pattern: set(r.docs) for r in rows.groupBy("docs").agg(first.alias("pattern")).collect()}
    # greedy cover: most uncovered toxic rows for the clean rows it costs; ties: more letters, then by text
    open_docs, weights = set().union(*docs_of.values()), {}
    key = lambda p, new: (-(new - 2 * in_clean[p]), -len(p.strip()), p, new)
    gain = [key(p, len(d)) for p, d in docs_of.items()]
    heapq.heapify(gain)
    while gain:
        *_, p, new = heapq.heappop(gain)
        now = len(docs_of[p] & open_docs)
        if now < new:
            if now:
                heapq.heappush(gain, key(p, now))
            continue
        if now - 2 * in_clean[p] < min(2, n_toxic):
            break
        weights[p] = odds[p]
        open_docs -= docs_of[p]
    # words of a list often come together in a row, so cover alone would miss entries: take every entry as strong as those and no finer
    for p in sorted(counts, key=lambda x: (-counts[x], len(x), x)):
        if p.endswith(" ") and p not in weights and counts[p] >= 0.02 * n_toxic and in_clean[p] == 0 and not any(p.startswith(q) for q in weights):
            weights[p] = odds[p]
    lexicon = Lexicon(weights, _exceptions(chosen, weights))
    return _fit(lexicon, chosen)


def _exceptions(chosen: DataFrame, weights: dict[str, float]) -> list[str]:
    bare = Lexicon(weights)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = bare.matcher()
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                t = fold(text)
                own = set()
                for s in bare.matches(machine, t):
                    e = t.index(" ", s + 1)
                    left, right = t.rfind(" ", 0, s), t.find(" ", e + 1)
                    own |= ({t[left:e + 1]} if left >= 0 else set()) | ({t[s:right + 1]} if right >= 0 else set())
                out += [(p, int(toxic)) for p in own]
            yield pd.DataFrame(out, columns=["phrase", "toxic"])

    found = chosen.select("text", "toxic").mapInPandas(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    return sorted(r.phrase for r in found.where("bad = 0 and n >= 2").collect())


def _fit(lexicon: Lexicon, chosen: DataFrame, steps: int = 400, ridge: float = 1e-3) -> Lexicon:
    """Logistic weights on the sample's (raw, density, length); the bias is not penalised."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.matcher()
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                t = fold(text)
                out.append((*_features(sum(lexicon.matches(machine, t).values()), t.count(" ") - 1), float(toxic)))
            yield pd.DataFrame(out, columns=["a", "b", "c", "y"])

    data = chosen.select("text", "toxic").mapInPandas(measure, "a double, b double, c double, y double").toPandas().sort_values(["a", "b", "c", "y"]).to_numpy()
    x, y = np.c_[np.ones(len(data)), data[:, :3]], data[:, 3]
    w = np.zeros(4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.diag([1e-6, 1, 1, 1]) + 1e-9 * np.eye(4)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    lexicon.logistic = tuple(float(v) for v in w)
    return lexicon


def _score(lexicon: Lexicon, machine, text: str | None) -> tuple[float, int, int]:
    """Score, matches and words of a text."""
    folded = fold(text)
    hits, words = lexicon.matches(machine, folded), folded.count(" ") - 1
    bias, *w = lexicon.logistic
    z = bias + sum(a * b for a, b in zip(w, _features(sum(hits.values()), words)))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), len(hits), words


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tox_score, tox_matches, tox_words) per row, from the whole text.

    Null and empty texts have no matches and get the score of a text without words. Repeated rows stay.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.matcher()
        for batch in batches:
            out = [_score(lexicon, machine, t) for t in batch["text"]]
            got = pd.DataFrame(out, columns=["tox_score", "tox_matches", "tox_words"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), got], axis=1)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(score, f"doc_id {kind}, tox_score double, tox_matches bigint, tox_words bigint")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with their columns. Scoring and choosing are one pass."""
    at = docs.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for batch in batches:
            yield batch.filter(pa.array([_score(lexicon, machine, t)[0] < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    rows, names = renamed(docs)
    return rows.mapInArrow(choose, rows.schema).select(*restored(names))


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the ``sample`` labelled training ids with the smallest hashes; of several labels the largest holds."""
    ids = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = staged(ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample), "toxic-ids")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(labelled_rows(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score_toxicity(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted"), "tox_matches", "tox_words")
