"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over ASCII characters are trained from labelled samples, one of random
strings and one of ordinary identifiers. A run of token characters of ``min_run`` or more is a secret
of kind ``markov`` if its mean log-likelihood ratio per character is at least ``threshold`` nats and the
ratio of the whole at least ``evidence`` nats, so short runs must be the more certain. Of any other run the windows of at least ``min_run`` characters that exceed the threshold most are secrets, one
after another, each widened to the next of ``=/_-``, so ordinary text beside a token does not hide it.
A run or window of less than ``min_run`` / 2 different character pairs (a ruler, a stretched word) is not
random. UUIDs name things and are no secrets; they end a run. What base spans leave of a secret is one if its own mean reaches the threshold. Dots split runs,
so addresses and file names fall apart into short pieces.

Texts are scanned as UTF-8 bytes, whole, one row at a time; spans are turned into code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import read_table, renamed

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]+")
_UUID = re.compile(rb"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
MIN_RUN = 16
THRESHOLD = 0.5
EVIDENCE = 12.0

#: Words that identifiers are made of.
_WORDS = ("account address array async base batch buffer build cache call check client code column config connection content context control count create current "
          "data date default delete description device document driver element engine error event export factory field file filter format function get group "
          "handler header height helper host image import index init input instance item key kind label length level limit line link list load local log main "
          "manager map message method model module name network node number object offset option order output page parent parse path place plan point pool port "
          "process property query queue range read record region register remote remove request resource response result return root row run schema score "
          "search select server service session set shape size source start state status storage stream string table target task test text thread time token "
          "total tree type update upload user value vector version view width window worker write year zone").split()


def random_samples(n: int = 600) -> list[str]:
    """Labelled random strings: digests in hex, base 64 and letters with digits."""
    out = []
    for i in range(n):
        d = hashlib.sha512(f"random {i}".encode()).digest()
        alphabet = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")[i % 4]
        out.append("".join(alphabet[b % len(alphabet)] for b in d))
    return out


def ordinary_samples(n: int = 3000) -> list[str]:
    """Labelled identifiers: words joined in the usual ways, some with a number."""
    out = []
    for i in range(n):
        d = hashlib.sha256(f"ordinary {i}".encode()).digest()
        words = [_WORDS[(d[2 * k] * 256 + d[2 * k + 1]) % len(_WORDS)] for k in range(3 + d[30] % 4)]
        text = ("_".join(words), "-".join(words), "/".join(words), "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]), "_".join(words).upper(), "".join(words))[i % 7]
        out.append(text + (str(d[31] % 1000 + 1000 * (d[29] % 3 == 0)) if d[28] % 3 else ""))
    return out


def train_ratio(random: list[str], ordinary: list[str], smoothing: float = 0.3) -> np.ndarray:
    """128 x 128 log-likelihood ratios of a character after another, positive for random; row 0 starts."""
    def chain(samples: list[str]) -> np.ndarray:
        counts = np.full((128, 128), smoothing)
        for s in samples:
            codes = np.frombuffer(b"\0" + s.encode("ascii", "ignore"), np.uint8)
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        return np.log(counts / counts.sum(axis=1, keepdims=True))
    return chain(random) - chain(ordinary)


@lru_cache(maxsize=1)
def default_ratio() -> np.ndarray:
    return train_ratio(random_samples(), ordinary_samples())


_HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_RUN_MAP = bytes(104 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" else 32 for c in range(256))
_EDGES = b"=/_-"


def _random_parts(run: bytes, ratio: np.ndarray, threshold: float, min_run: int, evidence: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: the whole of it, or its best windows."""
    codes = np.frombuffer(b"\0" + run, np.uint8)
    pairs = codes[:-1].astype(np.int32) * 128 + codes[1:]
    sums = np.r_[0, np.cumsum(ratio[codes[:-1], codes[1:]] - threshold)]
    certain = lambda a, z: sums[z] - sums[a] + threshold * (z - a) >= evidence and len(np.unique(pairs[a:z])) >= min_run // 2
    if sums[-1] >= 0:
        return [(0, len(run))] if certain(0, len(run)) else []
    out, open_parts = [], [(0, len(run))]
    while open_parts:
        lo, hi = open_parts.pop()
        if hi - lo < min_run:
            continue
        least = np.minimum.accumulate(sums[lo:hi + 1 - min_run])
        gains = sums[lo + min_run:hi + 1] - least
        end = int(np.argmax(gains))
        if gains[end] < 0:
            continue
        a, z = lo + int(np.argmin(sums[lo:lo + end + 1])), lo + min_run + end
        if certain(a, z):
            a = max([lo, *(run.rfind(c, lo, a) + 1 for c in _EDGES)])
            z = min([hi, *(k for c in _EDGES if (k := run.find(c, z, hi)) >= 0)])
            out.append((a, z))
        open_parts += [(lo, a), (z, hi)]
    return out


def _left_of(a: int, z: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Pieces of [a, z) that no base span covers; ``base`` is sorted."""
    out = []
    for s, e, _ in base:
        if s < z and a < e:
            if a < s:
                out.append((a, s))
            a = max(a, e)
    return [*out, (a, z)] if a < z else out


def _runs(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of token characters, without the UUIDs in them."""
    for m in _RUN.finditer(data):
        at = m.start()
        for u in _UUID.finditer(data, *m.span()) if m.end() - at >= 36 else ():
            yield at, u.start()
            at = u.end()
        yield at, m.end()


def find_secrets(data: bytes, ratio: np.ndarray, threshold: float = THRESHOLD, min_run: int = MIN_RUN, evidence: float = EVIDENCE) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes by start, then by kind as in KINDS."""
    base = []
    if b"=" in data or b":" in data:
        base += [(*m.span(), "assign") for m in _ASSIGN.finditer(data) if len(m[2]) >= 12]
    if b"AKIA" in data:
        base += [(*m.span(), "access") for m in _ACCESS.finditer(data) if len(m[0]) >= 18]
    if b"h" * 16 in data.translate(_HEX_MAP):
        base += [(*m.span(), "hex") for m in _HEX.finditer(data)]
    found, base, first = list(base), sorted(base), 0
    reach = [*accumulate((e for _, e, _ in base), max)]
    if b"h" * min_run in data.translate(_RUN_MAP):
        for a, z in _runs(data):
            if z - a < min_run:
                continue
            while first < len(base) and reach[first] <= a:
                first += 1
            last, run = bisect_left(base, (z,), first), data[a:z]
            for s, e in _random_parts(run, ratio, threshold, min_run, evidence):
                left = _left_of(a + s, a + e, base[first:last])
                if left != [(a + s, a + e)]:
                    codes = np.frombuffer(b"\0" + run, np.uint8)
                    left = [(x, y) for x, y in left if ratio[codes[x - a:y - a], codes[x - a + 1:y - a + 1]].mean() >= threshold]
                found += [(x, y, "markov") for x, y in left]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if data.isascii() or not spans:
        return spans
    marks, at, count = {}, 0, 0
    for b in sorted({x for s, e, _ in spans for x in (s, e)}):
        count += len(data[at:b].decode())
        at, marks[b] = b, count
    return [(marks[s], marks[e], k) for s, e, k in spans]


def scan_secrets(docs: DataFrame, *, text: str = "text", random: list[str] | None = None, ordinary: list[str] | None = None,
                 threshold: float = THRESHOLD, min_run: int = MIN_RUN, evidence: float = EVIDENCE) -> DataFrame:
    """``docs`` with array ``secret_spans`` of (start, end, kind) in code points and ``redacted`` text.

    A null text has no spans and stays null; an empty one stays empty. Overlapping spans are redacted
    as one. Other columns pass through; columns of these two names are replaced. Repeated rows stay.
    """
    ratio = default_ratio() if random is None and ordinary is None else train_ratio(random or random_samples(), ordinary or ordinary_samples())
    docs = docs.drop("secret_spans", "redacted")
    schema = docs.select("*", F.expr("cast(null as array<struct<start:bigint,end:bigint,kind:string>>)").alias("secret_spans"), F.lit(None).cast("string").alias("redacted")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            spans, redacted = [], []
            for value in column.cast(pa.binary()).to_pylist():
                data = value or b""
                found = find_secrets(data, ratio, threshold, min_run, evidence)
                if found:
                    out, at = [], 0
                    for s, e, k in found:
                        if s >= at:
                            out += [data[at:s], f"[{k}]".encode()]
                        at = max(at, e)
                    value = b"".join(out) + data[at:]
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in _code_points(data, found)])
                redacted.append(None if value is None else value.decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind), pa.array(redacted, pa.string())], [*batch.schema.names, "secret_spans", "redacted"])

    return docs.mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets, and ``n_chars``, if there, counted anew in these rows.

    All rows stay, and all other columns whatever their names.
    """
    rows, names = renamed(docs)
    now = {old: new for new, old in names.items()}
    found = F.size("secret_spans") > 0
    changed = {text: F.when(found, F.col("redacted")).otherwise(F.col(now[text]))}
    if n_chars in now:
        changed[n_chars] = F.when(found, F.length("redacted").cast(docs.schema[n_chars].dataType)).otherwise(F.col(now[n_chars]))
    return scan_secrets(rows, text=now[text], **options).select(*[changed.get(old, F.col(new)).alias(old) for new, old in names.items()])


def op8_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans in every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = scan_secrets(docs).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long")
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return spans.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(joined(F.filter("secret_spans", lambda s: s.kind != "markov")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("secret_spans")).alias("spans"), count("markov").alias("n_markov"))
