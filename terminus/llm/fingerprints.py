"""Document fingerprints from prefix polynomial hashes.

For a text with code points c0, c1, .. the prefix array holds
``P[i] = sum of (c_j + 1) * B**j for j < i`` modulo 2**31 - 1, for two bases. The
hash of any span is ``(P[j] - P[i]) * B**-i``: spans are compared in constant
time without touching their characters, and the longest common extension of two
positions is found by binary search. The fingerprint keeps the hash of the whole
text and the ``KEEP`` smallest (mixed) hashes of its spans of ``SPAN`` code
points, read off the prefix array; the likeness of two fingerprints is the
bottom-k estimate of the Jaccard similarity of their span sets.

Neighbours in descending doc_id order meet without a global sort in one task:
the ids are cut into parts of about ``PART_BYTES`` of text, the texts are dealt
to their parts once, and each part also gets the first text of the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import mix64
from terminus.llm.running import prefix_sums

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253 % PRIME)
SPAN = 24
KEEP = 64
PART_BYTES = 32 << 20
LOWEST = -(1 << 63)


def _fold(x: np.ndarray) -> np.ndarray:
    """A congruent value modulo the Mersenne prime, below 2**31 + x / 2**31."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """The residue modulo the prime; x < 2**62 or so."""
    x = _fold(_fold(x))
    return x - np.uint64(PRIME) * (x >= np.uint64(PRIME))


class Powers:
    """Tables of B**i and B**-i, grown by doubling to the longest text seen."""

    def __init__(self, base: int):
        self.steps = base, pow(base, -1, PRIME)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            have = len(self.tables[0])
            for i, step in enumerate(self.steps):
                self.tables[i] = np.concatenate([self.tables[i], _mod(self.tables[i] * np.uint64(pow(step, have, PRIME)))])
        return self.tables[0][:n], self.tables[1][:n]


POWERS = [Powers(b) for b in BASES]


class Prefixes:
    """Prefix arrays of one text; answers span questions."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for powers in POWERS:
            p = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold(codes * powers.upto(self.n + 1)[0][:self.n]), out=p[1:])
            self.sums.append(_fold(p))

    def windows(self, length: int) -> np.ndarray:
        """62-bit hashes of all spans of ``length``, in order of their start."""
        out, n = np.zeros(max(0, self.n - length + 1), np.uint64), self.n - length + 1
        for powers, p in zip(POWERS, self.sums, strict=True):
            if n > 0:
                gap = _fold(p[length:] + np.uint64(4 * PRIME) - p[:n])
                out = (out << np.uint64(31)) | _mod(gap * powers.upto(self.n + 1)[1][:n])
        return out

    def span(self, start: int, length: int) -> int:
        """The hash of one span."""
        out = 0
        for powers, p in zip(POWERS, self.sums, strict=True):
            gap = int(p[start + length]) - int(p[start])
            out = out << 31 | gap * int(powers.upto(self.n + 1)[1][start]) % PRIME
        return out


def joined_span(a: Prefixes, take: int, b: Prefixes, more: int) -> int:
    """Hash of the first ``take`` code points of a followed by ``more`` of b."""
    out = 0
    for powers, p, q in zip(POWERS, a.sums, b.sums, strict=True):
        out = out << 31 | (int(p[take]) + int(q[more]) * int(powers.upto(take + 1)[0][take])) % PRIME
    return out


def spans_equal(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return a.span(i, length) == b.span(j, length)


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common span starting at ``i`` of a and ``j`` of b."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if spans_equal(a, i, b, j, mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The KEEP smallest distinct values, ascending."""
    some = hashes
    if len(hashes) > 8 * KEEP:
        some = hashes[hashes < np.uint64((4 * KEEP << 32) // len(hashes))]
    some = np.unique(some)
    if len(some) < KEEP and len(hashes) > 8 * KEEP:  # many equal spans
        some = np.unique(hashes)
    return some[:KEEP]


def _mark(n: int, whole: int, spans: np.ndarray) -> str:
    return f"{n:x}-{whole:016x}-{_smallest(spans).astype('>u4').tobytes().hex()}" if n else "0--"


class Document:
    """A text with its prefix arrays, span hashes and fingerprint."""

    def __init__(self, text: str):
        self.text, self.prefixes = text, Prefixes(text)
        # A text shorter than a span counts as one span.
        self.spans = mix64(self.prefixes.windows(min(SPAN, max(1, len(text))))) >> np.uint64(32)
        self.fingerprint = _mark(len(text), self.prefixes.span(0, len(text)), self.spans)

    def edited(self, other: Document) -> tuple[str, str]:
        """The text whose last half is replaced by the start of ``other``, and its
        fingerprint. Spans that lie in either part are known; only those across the
        seam are hashed, and the whole is composed from two prefix hashes."""
        own, half = self.text, len(self.text) // 2
        keep, more = len(own) - half, min(half, len(other.text))
        text = own[:keep] + other.text[:more]
        if len(text) < SPAN:
            return text, fingerprint(text)
        seam = Prefixes(own[max(0, keep - SPAN + 1):keep] + other.text[:min(more, SPAN - 1)]).windows(SPAN)
        spans = np.concatenate([self.spans[:max(0, keep - SPAN + 1)] if len(own) >= SPAN else [],
                                mix64(seam) >> np.uint64(32),
                                other.spans[:max(0, more - SPAN + 1)] if len(other.text) >= SPAN else []]).astype(np.uint64)
        return text, _mark(len(text), joined_span(self.prefixes, keep, other.prefixes, more), spans)


def fingerprint(text: str) -> str:
    """``length-whole-spans`` in hex; equal for equal texts."""
    return Document(text).fingerprint


def likeness(a: str, b: str) -> float:
    """Share of the union's smallest spans that both have; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (bytes.fromhex(s.rpartition("-")[2]) for s in (a, b))
    x, y = np.frombuffer(x, ">u4"), np.frombuffer(y, ">u4")
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:KEEP]
    return float(np.isin(union, x).dot(np.isin(union, y).astype(np.int64))) / len(union)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts in order; the last row of a part is only a neighbour."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "shared_prefix_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    last = None  # part, doc_id, document
    for batch in batches:
        out = []
        for part, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            doc = Document(text.as_py() or "")
            if last is not None and last[0] == part:
                own = last[2]
                edited, mark = own.edited(doc)
                out.append((last[1], len(own.text), hashlib.sha256(edited.encode()).hexdigest(), own.fingerprint, mark,
                            likeness(own.fingerprint, mark), likeness(own.fingerprint, doc.fingerprint),
                            longest_common_extension(own.prefixes, 0, doc.prefixes, 0)))
            last = part, doc_id, doc
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def compare_neighbours(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, shared_prefix_next``, one row per
    input row.

    The next document is the next row in descending doc_id order, after the last
    one the first. Rows that repeat a doc_id follow one another by a hash of
    their text; a null doc_id stands at the end. A null text is empty; an empty
    text is like an empty one (1) and unlike all others (0). Only doc_id and
    text are read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("sid", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("tie", F.xxhash64("text"))
    light = rows.select("sid", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("size"))
    sized = prefix_sums(light, [F.col("sid").desc(), F.col("tie")], {"before": F.col("size")})
    # One row per part_bytes of text.
    firsts = sorted({r["sid"] for r in sized.groupBy(F.floor(F.col("before") / part_bytes).alias("part"))
                     .agg(F.max("sid").alias("sid")).collect()}, reverse=True)
    if not firsts:
        firsts = [0]
    n_parts = len(firsts)
    ascending = np.array(firsts[::-1], np.int64)

    @F.pandas_udf("int")
    def part_of(sid: pd.Series) -> pd.Series:
        # Descending parts: part k holds firsts[k] >= sid > firsts[k + 1].
        return pd.Series(n_parts - 1 - np.searchsorted(ascending, sid.to_numpy()) if n_parts > 1
                         else np.zeros(len(sid), int)).clip(lower=0).astype("int32")

    dealt = rows.select(part_of("sid").alias("part"), F.lit(0).alias("late"), "sid", "tie", "doc_id", "text")
    spark = docs.sparkSession
    heads = spark.createDataFrame([(s, (k - 1) % n_parts) for k, s in enumerate(firsts)], "sid bigint, part int")
    lead = (rows.join(F.broadcast(heads), "sid").groupBy("part").agg(F.min(F.struct("tie", "sid", "doc_id", "text")).alias("h"))
            .select("part", F.lit(1).alias("late"), "h.sid", "h.tie", "h.doc_id", "h.text"))
    return (dealt.unionByName(lead).repartition(n_parts, "part").sortWithinPartitions("part", "late", F.desc("sid"), "tie")
            .select("part", "doc_id", "text")
            .mapInArrow(_compared, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                        "edited_fingerprint string, near_edited double, near_next double, shared_prefix_next bigint"))
