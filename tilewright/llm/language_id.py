"""Language identification by compression: the language whose dictionary codes a text smallest.

Each language has a raw-content zstandard dictionary: folded text of its own labelled rows. A text is
folded (lower case, ASCII characters that are no letters become one space), cut into pieces of ``PIECE``
bytes at word ends and every piece is coded with the dictionary of each language; the language with the
smallest sum wins. Pieces are coded apart, so that a long text can't become its own dictionary and its
evidence grows with its length. Texts whose two smallest sums differ by less than ``NARROW`` of the
second, or by less than ``LEAST`` bytes, are coded again by the optimal parser, which finds shorter
matches, behind carriers of the commonest words of all languages: a few words alone would be stored as
they are, at one size for all dictionaries. If the margin is still that narrow the text is rejected:
``accepted`` is false, the best guess stays in ``lang_pred``.

Dictionaries come from a bounded sample: for each language the ``SAMPLE`` distinct texts with the
smallest hashes, up to ``SLICE`` characters each, and ``DICT_BYTES`` of them in a dictionary, fewer where
all dictionaries together would exceed ``ALL_BYTES``. Whole texts are classified, never prefixes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import held_out, read_table, staged

SAMPLE = 400
SLICE = 4_000
DICT_BYTES = 112_640
ALL_BYTES = 64_000_000
PIECE = 8_192
NARROW = 0.02
LEAST = 3
#: Languages whose counts are broadcast; those of more are joined as Spark chooses.
BROADCAST = 10_000
#: Words of each language in a carrier, and carriers: the same words from another language on.
CARRIER, CARRIERS = 40, 4
UNKNOWN = "und"
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    """Lower-case words of letters between single spaces, with a space at both ends; empty without a letter."""
    words = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    return b" " + words + b" " if words else b""


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def pieces(folded: bytes, most: int = PIECE) -> list[bytes]:
    """``folded`` in pieces of ``most`` bytes or less, cut at spaces where there are any."""
    out, at = [], 0
    while len(folded) - at > most:
        cut = folded.rfind(b" ", at + 1, at + most) + 1 or at + most
        out.append(folded[at:cut])
        at = cut
    return [*out, folded[at:]]


def dictionary(texts: list[bytes], most: int) -> bytes:
    """Up to ``most`` bytes of folded texts: those with words that are new at first, the commonest words at the end.

    Offsets to the end of a dictionary cost least, so the words that occur most stand there.
    """
    counts = Counter(w for t in texts for w in t.split())
    common, used = [], 0
    for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n < 3 or used > most // 8:
            break
        common.append(w)
        used += len(w) + 1
    body, size = [], used
    for t in texts:
        if size >= most:
            break
        body.append(t[: most - size])
        size += len(body[-1])
    return (b"".join(reversed(body)) + b" " + b" ".join(reversed(common)) + b" ")[-most:]


class Coder:
    """Coded sizes of texts with one dictionary a language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.fast = [self._coder(dictionaries[n], zstd.STRATEGY_GREEDY, 4, 2) for n in self.names]
        self.fine = [self._coder(dictionaries[n], zstd.STRATEGY_BTULTRA2, 3, 9) for n in self.names]
        common = [b" ".join(dictionaries[n].split()[-CARRIER:]) for n in self.names]
        self.carriers = [b" ".join(common[k:] + common[:k]) for k in range(min(len(common), CARRIERS))]
        self.carried = self.sizes(self.fine, self.carriers) / max(1, len(self.carriers))

    @staticmethod
    def _coder(content: bytes, strategy: int, min_match: int, search_log: int) -> zstd.ZstdCompressor:
        params = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=18, hash_log=16, chain_log=16, search_log=search_log, min_match=min_match, target_length=64, strategy=strategy,
                                                write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=data, compression_params=params)

    @staticmethod
    def sizes(coders: list[zstd.ZstdCompressor], parts: list[bytes]) -> np.ndarray:
        return np.array([sum(len(c.compress(p)) for p in parts) for c in coders])

    @staticmethod
    def narrow(sizes: np.ndarray) -> bool:
        if len(sizes) < 2:
            return False
        best, second = np.partition(sizes, 1)[:2]
        return bool(second - best < max(LEAST, NARROW * second))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin as a share of the second size, and whether the margin is wide enough."""
        folded = fold(text)
        if not folded or not self.names or not has_letter(text):
            return UNKNOWN, 0.0, 0.0, False
        parts = pieces(folded)
        sizes = self.sizes(self.fast, parts)
        if self.narrow(sizes):
            sizes = self.sizes(self.fine, [c + p for p in parts for c in self.carriers]) / len(self.carriers) - len(parts) * self.carried
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = 1.0 - best / max(1, sizes[order[1]]) if len(order) > 1 else 1.0
        score = 1.0 / np.exp2(-np.minimum(sizes - best, 1000).astype(float)).sum()
        return self.names[order[0]], float(score), float(margin), not self.narrow(sizes)


@lru_cache(maxsize=2)
def _coder(items: tuple[tuple[str, bytes], ...]) -> Coder:
    return Coder(dict(items))


def learn_dictionaries(labelled: DataFrame, *, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each language of (text, lang) rows.

    Rows whose language is null, or whose text is null or has no letter, teach nothing. Equal texts of a language count once.
    """
    rows = labelled.where("lang is not null and text rlike '\\\\p{L}'").select("lang", "text", F.xxhash64("text").alias("h"))
    # of n distinct texts about twice the sample passes the bound on hashes, so only these are sorted
    sizes = staged(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).withColumnRenamed("lang", "of"), "language-sizes")
    known = F.broadcast(sizes) if sizes.count() <= BROADCAST else sizes
    bound = F.expr(f"least(1.0d, {2.0 * sample + 50} / n) * 9223372036854775807d * 2 - 9223372036854775807d")
    few = rows.join(known, F.col("lang") == F.col("of")).where(F.col("h") <= bound).groupBy("lang", "h").agg(F.min(F.substring("text", 1, SLICE)).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = staged(few.withColumn("place", place).where(F.col("place") <= sample).drop("place"), "language-sample")
    names = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    most = min(DICT_BYTES, ALL_BYTES // max(1, len(names)))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h")) - F.octet_length("text")
    texts: dict[str, list[bytes]] = {}
    for r in chosen.withColumn("before", size).where(F.col("before") < 2 * most).orderBy("lang", "h").collect():
        texts.setdefault(r.lang, []).append(fold(r.text))
    return {name: dictionary(t, most) for name, t in texts.items()}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin, accepted) per row, from the whole text.

    lang_pred is the language whose dictionary codes the text smallest, the first by name of several;
    ``und`` with score 0 for a null text, a text without a letter, or if no language is known. accepted
    says that the margin isn't narrow; ``und`` is never accepted. Repeated rows stay.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    models = tuple(sorted(dictionaries.items()))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(models)
        for batch in batches:
            found = [coder(t) for t in batch.column(1).to_pylist()]
            lang, score, margin, accepted = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "margin", "accepted"])

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(identify, f"doc_id {kind}, lang_pred string, score double, margin double, accepted boolean")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = learn_dictionaries(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return identify_language(docs, dictionaries).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
