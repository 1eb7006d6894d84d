"""Hard-negative mining by Kronecker-packed products.

Components become integers, floor(``SCALE`` * x). The components of several
candidates, biased to be non-negative, stand in separated fields of one wide
integer; a field is as wide as the largest possible sum of products. One
product per anchor component then serves all candidates of the word, and the
exact scores are read out of its fields. A wide integer is a double with whole
value below 2**53, so a block of words times a block of anchors is one matrix
product. Where a single field needs more bits, the words are Python integers.

The rows lie in chunks of at most about ``CHUNK_VALUES`` components. Every
anchor visits every chunk (the stated query set against all rows, in blocks):
partitions are sorted by chunk, candidates first, and read as a stream, so a
task holds one chunk and a slice of anchors. A chunk returns the best rows per
anchor only, and windows with a limit merge them. Nothing is grouped by label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terminus.llm.common import written

SCALE = 256
CHUNK_VALUES = 1 << 22
LEAST_CHUNKS = 16
SCORE_CELLS = 1 << 20
WORD_BITS = 53
OBJECT_FIELDS = 8
LONG = (1 << 63) - 1


class Packed:
    """Candidates of one length, ready for products with many anchors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows  # whole-valued doubles, one row per candidate
        self.low = int(rows.min())
        self.top = int(rows.max()) - self.low
        self.sums = None
        self.words: dict[int, np.ndarray] = {}

    def _pack(self, bits: int, fields: int, wide: bool) -> np.ndarray:
        """Field j of word i is candidate j * n_words + i."""
        key = bits if not wide else -bits
        if key not in self.words:
            n, d = self.rows.shape
            n_words = -(-n // fields)
            biased = self.rows.astype(object) if wide else self.rows
            if wide:
                biased = np.frompyfunc(int, 1, 1)(biased)
            biased = biased - self.low
            words = np.zeros((n_words, d), object if wide else np.float64)
            for j in range(fields):
                part = biased[j * n_words:(j + 1) * n_words]
                words[:len(part)] += part * (1 << (bits * j))
            self.words = {key: words}  # one layout at a time
        return self.words[key]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, one row per anchor: int64, or Python integers
        where they may need more than 53 bits."""
        n, d = self.rows.shape
        low, top = int(anchors.min()), int(anchors.max()) - int(anchors.min())
        bits = max(1, (d * self.top * top).bit_length())
        size = (d * max(abs(self.low), abs(self.low + self.top)) * max(abs(low), abs(low + top))).bit_length()
        wide = max(bits, size) > WORD_BITS
        fields = OBJECT_FIELDS if wide else WORD_BITS // bits
        words = self._pack(bits, fields, wide)
        if wide:
            whole = np.frompyfunc(int, 1, 1)
            biased, rows = whole(anchors.astype(object)) - low, whole(self.rows.astype(object))
            product, sums = biased.dot(words.T), rows.sum(axis=1)
        else:
            biased = anchors - low
            product = (biased @ words.T).astype(np.int64)
            if self.sums is None:
                self.sums = self.rows.sum(axis=1).astype(np.int64)
            sums = self.sums
        mask = (1 << bits) - 1
        out = np.concatenate([(product >> (bits * j)) & mask for j in range(fields)], axis=1)[:, :n]
        # sum (c - low_c)(a - low_a) = sum c a - low_c sum a - low_a sum c + d low_a low_c
        own = biased.sum(axis=1) + d * low if wide else biased.sum(axis=1).astype(np.int64) + d * low
        return out + self.low * own[:, None] + low * sums[None, :] - d * low * self.low


def _vector(raw: bytes, short: bool) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if short else "<f8").astype(np.float64)


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, short = [], []
            for v in batch.column(2):
                q = np.floor(scale * np.asarray(v.as_py(), np.float64))
                short.append(bool((np.abs(q) <= 32767).all()))
                raw.append(q.astype("<i2" if short[-1] else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(short), pa.array(raw, pa.binary())],
                                             ["vec_id", "label", "anchor", "short", "vector"])
    return run


def _first(scores: np.ndarray, ids: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    """The k of ``which`` with the highest scores, equal ones by smaller id."""
    if len(which) > k:
        kth = np.partition(scores[which], len(which) - k)[len(which) - k]
        which = which[scores[which] >= kth]
    return which[np.lexsort((ids[which], -scores[which]))][:k]


def _long(x) -> int:
    return max(-LONG - 1, min(LONG, int(x)))


def _visits(visit: Callable, out: pa.Schema):
    """Stream a partition sorted by (chunk, kind): hold the candidates (kind 0)
    of a chunk, then call ``visit(ids, labels, scores, anchor)`` for each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, packed = None, [], None
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            anchors: list[dict] = []

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal packed
                if packed is None:
                    packed = {}
                    for d in {len(v) for _, _, v in rows}:
                        mine = [r for r in rows if len(r[2]) == d]
                        packed[d] = (np.array([r[0] for r in mine], np.int64), np.array([r[1] for r in mine], np.int64),
                                     Packed(np.stack([r[2] for r in mine])))
                    rows.clear()
                for d in {len(a["x"]) for a in anchors} & packed.keys():
                    ids, labels, block = packed[d]
                    mine = [a for a in anchors if len(a["x"]) == d]
                    step = max(1, SCORE_CELLS // len(ids))
                    for at in range(0, len(mine), step):
                        scores = block.scores(np.stack([a["x"] for a in mine[at:at + step]]))
                        found = [r for a, s in zip(mine[at:at + step], scores, strict=True) for r in visit(ids, labels, s, a)]
                        if found:
                            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in found], schema=out)
                anchors.clear()

            for i, (c, kind) in enumerate(zip(col["chunk"], col["kind"], strict=True)):
                if c != chunk:
                    if anchors:
                        yield from flush()
                    chunk, packed = c, None
                    rows.clear()
                x = _vector(col["vector"][i], col["short"][i])
                if kind == 0:
                    rows.append((col["vec_id"][i], col["label"][i], x))
                elif rows or packed:
                    anchors.append({"id": col["vec_id"][i], "label": col["label"][i], "x": x,
                                    "positives": list(zip(col["p_ids"][i] or [], col["p_scores"][i] or [], strict=True))})
            if anchors:
                yield from flush()
    return run


POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE = pa.schema([*POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _positives(k: int):
    def visit(ids, labels, scores, anchor):
        which = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["id"]))
        return [(anchor["id"], int(ids[j]), _long(scores[j])) for j in _first(scores, ids, which, k)]
    return visit


def _negatives(k: int, low_pct: int, high_pct: int):
    def visit(ids, labels, scores, anchor):
        other, out = labels != anchor["label"], []
        for p_id, p in anchor["positives"]:
            if p < 0 < low_pct < high_pct:  # no score is both above the lower and below the upper share
                continue
            which = np.flatnonzero(other & (100 * scores >= low_pct * p) & (100 * scores <= high_pct * p))
            out += [(anchor["id"], p_id, p, int(ids[j]), _long(scores[j])) for j in _first(scores, ids, which, k)]
        return out
    return visit


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_pct: int = 80,
         high_pct: int = 100, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding, label, ..)`` -> ``anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score``.

    ``anchor`` marks the anchors (a condition on the columns of ``vectors``). An
    anchor's positives are its ``positives`` highest-scoring other rows of the same
    label; the negatives of a pair the ``negatives`` highest-scoring rows of other
    labels with low_pct * p <= 100 * score <= high_pct * p; equal scores by smaller
    vec_id. Rows with a null vec_id, label or vector, an empty vector, or a null,
    non-finite or (times ``scale``) overflowing component take no part. Only vectors
    of one length are compared. Rows that repeat a vec_id are rows of their own, but
    none is a positive of the anchor of the same vec_id; a repeated anchor is one,
    its smallest row by label and vector. Scores beyond 64 bits are returned as the
    nearest long. Empty tables, anchors without positives and pairs without
    negatives give no rows.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < F.lit(float("inf"))))
    rows = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"),
                           F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite))
    # The dealing is fixed by this write: a lost task reads the same chunks again.
    kept = written(rows.mapInArrow(_quantised(scale), "vec_id bigint, label bigint, anchor boolean, short boolean, vector binary")
                   .withColumn("deal", F.rand(42)))
    values = kept.agg(F.sum(F.length("vector") / F.when(F.col("short"), 2).otherwise(8)).alias("n")).first()["n"] or 0
    chunks = max(LEAST_CHUNKS, -(-int(values) // CHUNK_VALUES))
    none = F.array().cast("array<bigint>")
    candidates = kept.select(F.floor(F.col("deal") * chunks).cast("int").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "label", "short",
                             "vector", none.alias("p_ids"), none.alias("p_scores"))
    asked = (kept.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "short")).alias("r"))
             .select("vec_id", "r.label", "r.short", "r.vector"))

    def visited(anchors: DataFrame, visit: Callable, out: pa.Schema, ddl: str) -> DataFrame:
        calls = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "label",
                               "short", "vector", "p_ids", "p_scores")
        return (candidates.unionByName(calls).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
                .mapInArrow(_visits(visit, out), ddl))

    found = visited(asked.select("*", none.alias("p_ids"), none.alias("p_scores")), _positives(positives), POSITIVE,
                    "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = (found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives)
              .groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))  # at most ``positives``
              .select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores")))
    pairs = visited(written(asked.join(chosen, "vec_id")), _negatives(negatives, low_pct, high_pct), NEGATIVE,
                    "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def oracle_sql() -> str:
    """All anchors against all rows; expects ``embeddings`` without repeated vec_id."""
    return """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
