"""Packing token ids into windows by non-negative least squares.

A document is its token ids and one closing id. Whole windows are cut off its
front; the rest (0 < length < window) goes through the plan:

1. The histogram of rest lengths (fewer than ``window`` rows) is gathered.
2. Shallow combinations of two or three lengths that fill a window exactly are
   enumerated; repeat counts ``x >= 0`` solve ``min |A x - histogram|`` (FISTA),
   are rounded, and clipped so that no length is used more than it occurs. What
   is left is tried again with its own combinations, a few rounds.
3. The residual documents are packed greedily: each is cut into powers of two
   (its length in binary), and the pieces are laid end to end, largest first.
   Pieces and windows then never cross, and the last, shorter window falls into
   sequences of powers of two, which need no padding: nothing is padded at all.

Steps 2 and 3 work on the histogram only and have a size bounded by ``window``.
They turn into a table ``(length, rank range) -> place``; a document finds its
place from its rank among equal lengths, a distributed prefix sum. No sequence
is built in a group, so a hot length or source is not gathered anywhere. Every
cut is at a place that the document's length alone decides, so the checksums of
all pieces come from the one pass that reads the texts, and texts never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import free_memory, released, rows_per_batch, written
from terminus.llm.running import prefix_sums
from terminus.llm.tokens import Lookup, Pretokens

TOKENIZER = "word_bpe_49k.json"
WINDOW = 2048
CLOSING_ID = 1
TRIPLES = 6000
ITERATIONS = 400
ROUNDS = 6
BATCH_ROWS = 500


def ids_of(pre: Pretokens, lookup, text: str | None) -> bytes:
    """Little-endian unsigned 32-bit ids of a text and the closing id."""
    out = []
    for part, special in pre.parts(text or ""):
        if special is None:
            out.extend(map(lookup, pre.split(part)))
        else:
            out.append(int(special).to_bytes(4, "little"))
    out.append(CLOSING_ID.to_bytes(4, "little"))
    return b"".join(out)


def _lookup(pre: Pretokens):
    return Lookup(lambda piece: b"".join(i.to_bytes(4, "little") for i in pre.encode(piece)), bound=200_000).__getitem__


def binary_cuts(length: int) -> list[int]:
    """Ends of the pieces of a length cut into powers of two, largest first."""
    ends, at = [], 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def _measured(tokenizer: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = Pretokens(tokenizer)
        lookup, step = _lookup(pre), 4 * window
        free_memory()  # what reading the tokenizer file took
        for batch in batches:
            n, blocks, rest, parts = [], [], [], []
            for value in batch.column(2):
                ids = ids_of(pre, lookup, value.as_py())
                whole = len(ids) // step
                n.append(len(ids) // 4)
                blocks.append([zlib.crc32(ids[i * step:(i + 1) * step]) for i in range(whole)])
                left = ids[whole * step:]
                ends = [0, *binary_cuts(len(left) // 4)]
                rest.append(zlib.crc32(left))
                parts.append([zlib.crc32(left[4 * a:4 * b]) for a, b in zip(ends, ends[1:], strict=False)])
            crcs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(blocks, crcs),
                 pa.array(rest, pa.int64()), pa.array(parts, crcs)],
                ["doc_id", "text_key", "doc_tokens", "blocks", "rest_crc", "part_crcs"])
    return run


def combinations(hist: np.ndarray, triples: int = TRIPLES) -> np.ndarray:
    """Rows ``(a, b, c)``, a >= b >= c >= 0, that sum to ``len(hist)`` with all
    positive lengths present; of the triples, those whose scarcest length is
    most frequent."""
    window = len(hist)
    a = np.arange((window + 1) // 2, window)
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    pairs = pairs[(hist[pairs[:, 0]] > 0) & (hist[pairs[:, 1]] > 0)]
    have = np.flatnonzero(hist)
    b, c = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
    top = window - b - c
    ok = (b >= c) & (top >= b)
    ok[ok] &= hist[top[ok]] > 0
    trip = np.stack([top[ok], b[ok], c[ok]], 1)
    if len(trip) > triples:
        trip = trip[np.argsort(-hist[trip].min(axis=1), kind="stable")[:triples]]
    return np.concatenate([pairs, trip])


def repeat_counts(combos: np.ndarray, hist: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Whole repeat counts: NNLS by accelerated projected gradient, rounded and
    clipped to the lengths that are left."""
    if not len(combos):
        return np.zeros(0, np.int64)
    h = hist.astype(float).copy()
    h[0] = 0
    used = combos > 0

    def forward(x):
        y = np.bincount(combos.ravel(), np.repeat(x, 3), len(h))
        y[0] = 0
        return y

    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A^T A: the step size
        v = (forward(v)[combos] * used).sum(1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(iterations):
        nxt = np.maximum(0, y - ((forward(y) - h)[combos] * used).sum(1) / (1.01 * norm))
        t, s = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = nxt + (s - 1) / t * (nxt - x)
        x = nxt
    left, out = hist.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    for k in np.argsort(-x, kind="stable"):
        lengths, need = np.unique(combos[k][combos[k] > 0], return_counts=True)
        out[k] = min(int(np.floor(x[k] + 0.5)), *(left[lengths] // need).tolist())
        left[lengths] -= out[k] * need
    return out


def plan(hist: np.ndarray) -> tuple[pd.DataFrame, int, int]:
    """Places for rest lengths: rows ``rest, lo, hi, seq, at, bases`` (ranks
    lo..hi-1 of a length). ``seq`` >= 0: sequences seq, seq+1, .. at offset ``at``.
    ``seq`` = -1: cut into powers of two; ``bases`` are the places of the first
    document's pieces on the residual stream. Also the number of combination
    sequences and the length of the residual stream."""
    nxt, rows, seq = np.zeros(len(hist), np.int64), [], 0
    for _ in range(ROUNDS):  # what one set of combinations leaves over may fit another
        combos = combinations(hist - nxt)
        times = repeat_counts(combos, hist - nxt)
        if not times.any():
            break
        for (*lengths,), n in zip(combos.tolist(), times.tolist(), strict=True):
            at = 0
            for length in lengths if n else []:
                if length:
                    rows.append((length, int(nxt[length]), int(nxt[length]) + n, seq, at, []))
                    nxt[length] += n
                    at += length
            seq += n
    left = {r: int(hist[r] - nxt[r]) for r in np.flatnonzero(hist > nxt).tolist() if r}
    pieces = {b: sum(n for r, n in left.items() if r >> b & 1) for b in range(len(hist).bit_length())}
    start = {b: sum(n << c for c, n in pieces.items() if c > b) for b in pieces}
    used = dict.fromkeys(pieces, 0)
    for length, n in left.items():
        bits = [b for b in reversed(sorted(pieces)) if length >> b & 1]
        rows.append((length, int(nxt[length]), int(hist[length]), -1, 0, [start[b] + (used[b] << b) for b in bits]))
        for b in bits:
            used[b] += n
    table = pd.DataFrame(rows, columns=["rest", "lo", "hi", "seq", "at", "bases"])
    return table, seq, sum(r * n for r, n in left.items())


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> pieces ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.

    Every id of every row lies in exactly one piece. A null or empty text is the
    closing id alone. Repeated rows are packed once each; null doc_ids pass
    through. Only doc_id and text are read. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string"))
                        .alias("text_key"), F.col("text").cast("string").alias("text"))
    # Written at once: range partitioning evaluates its input twice.
    with rows_per_batch(spark, BATCH_ROWS):
        light = written(texts.mapInArrow(
            released(_measured(tokenizer, window)), "doc_id bigint, text_key bigint, doc_tokens bigint, blocks array<bigint>, "
            "rest_crc bigint, part_crcs array<bigint>").withColumn("rest", F.col("doc_tokens") % window))
    placed = written(prefix_sums(
        light, [F.col("rest"), F.col("doc_id"), F.col("text_key"), F.col("doc_tokens")],
        {"row": F.lit(1), "first_block": F.size("blocks")}))
    # Fewer than window rows.
    counts = placed.groupBy("rest").agg(F.count("*").alias("n")).toPandas()
    hist = np.zeros(window, np.int64)
    hist[counts["rest"].to_numpy(int)] = counts["n"].to_numpy(int)
    earlier = np.concatenate([[0], np.cumsum(hist)[:-1]])
    hist[0] = 0
    table, n_combined, stream = plan(hist)
    table["before"] = earlier[table["rest"].to_numpy(int)]
    n_stream = stream // window
    whole = n_stream * window
    ends = [whole, *(whole + e for e in binary_cuts(stream - whole))]  # of the sequences of the last window

    segments = spark.createDataFrame(
        table, "rest bigint, lo bigint, hi bigint, seq bigint, at bigint, bases array<bigint>, before bigint")
    rank = F.col("row") - F.col("before")
    # At most 3 rows per combination and round: bounded by window, TRIPLES and ROUNDS.
    rests = (placed.filter("rest > 0").join(F.broadcast(segments), "rest")
             .filter((rank >= F.col("lo")) & (rank < F.col("hi")))
             .withColumn("k", rank - F.col("lo"))
             .withColumn("start", F.col("doc_tokens") - F.col("rest")))
    combined = rests.filter("seq >= 0").select(
        "doc_id", "start", F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("seq") + F.col("k")).alias("sequence_id"), F.col("at").alias("offset"))

    bits = F.filter(F.array(*[F.lit(1 << b).cast("bigint") for b in reversed(range(window.bit_length()))]),
                    lambda p: F.col("rest").bitwiseAND(p) > 0)
    cut = (rests.filter("seq < 0").select("doc_id", "start", "rest", "doc_tokens", "k", F.posexplode(
        F.arrays_zip(bits.alias("size"), F.col("bases").alias("base"), F.col("part_crcs").alias("crc"))).alias("i", "p"))
           .withColumn("pos", F.col("p.base") + F.col("k") * F.col("p.size"))
           # What stands before a piece in its document: the larger bits of the length.
           .withColumn("ahead", F.col("rest") - F.col("rest") % (F.col("p.size") * 2)))
    tail = F.array(*[F.lit(e).cast("bigint") for e in ends])
    ended = F.filter(tail, lambda e: e <= F.col("pos"))
    in_whole = F.col("pos") < whole
    streamed = cut.select(
        "doc_id", (F.col("start") + F.col("ahead")).alias("start"), F.col("p.size").alias("length"),
        F.col("p.crc").alias("ids_crc32"), "doc_tokens",
        (n_combined + F.when(in_whole, F.floor(F.col("pos") / window)).otherwise(n_stream + F.size(ended) - 1))
        .cast("bigint").alias("sequence_id"),
        F.when(in_whole, F.col("pos") % window).otherwise(F.col("pos") - F.array_max(ended)).alias("offset"))
    first = n_combined + n_stream + len(ends)
    blocks = placed.select("doc_id", "doc_tokens", "first_block", F.posexplode("blocks").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i") * window).cast("bigint").alias("start"), F.lit(window).cast("bigint").alias("length"),
        "ids_crc32", "doc_tokens", (first + F.col("first_block") + F.col("i")).cast("bigint").alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))
    return combined.unionByName(streamed).unionByName(blocks)
