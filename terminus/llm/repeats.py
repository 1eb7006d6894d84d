"""Suffix-array dedup: bytes covered by a string of ``window`` bytes that starts
more than once anywhere in the corpus are removed.

The suffixes of all texts are ordered only through their first ``window`` bytes
by most-significant-digit passes of a radix sort. A pass deals the suffixes of
every bucket into finer buckets by the next digit; a bucket with one suffix is
finished, and what is still together after the last digit are exactly the
repeated windows. Any order of the digits will do, as only equality counts, so
they are chosen such that most suffixes finish early and neighbours move together:

* *First digit:* the ``GRAM`` bytes at the window's minimizer, the place in the
  window whose gram has the smallest hash. Equal windows have it at the same
  offset. All windows around one minimizer (about 70 in a row) are one record, a
  *run* of offsets, so about 1 record per 70 suffixes is dealt, not each suffix.
* *Later digits:* runs are cut at fixed offsets into cells of at most ``CELLS[i]``
  offsets; the digit is what all windows of the cell have in common: 177 of 200
  bytes, then 196, then 200. With cells of one offset the digit is the window.

A pass counts each bucket with map-side partial aggregates and joins the counts
back, so a bucket of any size is split over tasks and never gathered. Runs whose
whole extent is equal are equal in all their windows: they are decided together,
and one of them stands for all in the next pass.

Equal texts are read once, with their number. Texts are known by 76 bits of
hashes, digits by 64 bits (together with those of the earlier digits).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import Scratch, mix64, written

WINDOW = 200
GRAM = 32
CELLS = (24, 5, 1)
BLOCK_BYTES = 1 << 20
TAGS = 1 << 12
# A run in one long: 31 bits of place, twice 10 of offsets, 1 of "known to repeat", and the text's tag below.
AT_BITS, OFFSET_BITS, TAG_BITS = 31, 10, 12
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
RECORD = "digit bigint, whole bigint, text_key bigint, run bigint"


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) at each place."""
    n = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    h = np.full(n, np.uint64(gram))
    for j in range(0, gram, 8):
        h ^= h >> np.uint64(29)
        h += words[j:j + n] * FACTORS[j // 8 % 4]
        h *= np.uint64(0x9FB21C651E98DF25)
    return mix64(h)


def minimizers(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` neighbours the place of the smallest (by its
    upper 40 bits, the leftmost of equal ones)."""
    n = len(h)
    cells = np.full(-(-n // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    cells[:n] = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    cells = cells.reshape(-1, span)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - span + 1
    return (np.minimum(behind[:starts], ahead[span - 1:span - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _packed(place, low, high, done, tag):
    return ((((place << OFFSET_BITS | low) << OFFSET_BITS | high) << 1 | done) << TAG_BITS) | tag


def _unpacked(run):
    tag, run = run & (TAGS - 1), run >> TAG_BITS
    done, run = run & 1, run >> 1
    mask = (1 << OFFSET_BITS) - 1
    return run >> 2 * OFFSET_BITS, run >> OFFSET_BITS & mask, run & mask, done, tag


def _first_digit(window: int, gram: int):
    """(text_key, tag, copies, text) -> the runs of all windows."""
    span = window - gram + 1

    def block(pieces: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch | None:
        """Pieces (key, tag, done, place of the piece in its text, bytes)."""
        data = b"".join(p[4] for p in pieces)
        if len(data) < window:
            return None
        h = gram_hashes(data, gram)
        at = minimizers(h, span)
        sizes = np.array([len(p[4]) for p in pieces])
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        start = np.flatnonzero(owner[:len(at)] == owner[window - 1:window - 1 + len(at)])
        if not len(start):
            return None
        at = at[start]
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(start) != 1)) + 1
        low_start, high_start = start[np.concatenate([[0], cut])], start[np.concatenate([cut, [len(start)]]) - 1]
        place = at[np.concatenate([[0], cut])]
        low, high, who = place - high_start, place - low_start, owner[low_start]
        view = memoryview(data)
        whole = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(low_start.tolist(), (high_start + window).tolist(), strict=True)),
                            np.uint64, len(place)) ^ mix64((low << OFFSET_BITS | high).astype(np.uint64) + np.uint64(1))
        key, tag, done, base = (np.array([p[i] for p in pieces], np.int64)[who] for i in range(4))
        run = _packed(place - first[who] + base, low, high, done, tag)
        return pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(key), pa.array(run)],
                                          ["digit", "whole", "text_key", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            for key, tag, copies, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_buffer().to_pybytes()
                if len(data) < window:
                    continue
                key, tag, done = key.as_py(), tag.as_py(), int(copies.as_py() > 1)
                for base in range(0, len(data) - window + 1, BLOCK_BYTES):
                    pieces.append((key, tag, done, base, data[base:base + BLOCK_BYTES + window - 1]))
                    held += len(pieces[-1][4])
                    if held >= BLOCK_BYTES:
                        if (out := block(pieces)) is not None:
                            yield out
                        pieces, held = [], 0
        if pieces and (out := block(pieces)) is not None:
            yield out
    return run


def _next_digit(window: int, width: int):
    """(text_key, text, runs) -> the runs cut into cells of ``width`` offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for key, text, runs in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = memoryview(text.as_buffer().to_pybytes())
                place, low, high, done, tag = _unpacked(runs.values.to_numpy())
                digits, wholes, places, lows, highs, dones = [], [], [], [], [], []
                for a, lo, hi, d in zip(place.tolist(), low.tolist(), high.tolist(), done.tolist(), strict=True):
                    for cell in range(lo // width, hi // width + 1):
                        first, last = cell * width, cell * width + width - 1
                        left, right = max(lo, first), min(hi, last)
                        digits.append(digest(data[a - first:a - last + window], cell + 1))
                        wholes.append(digest(data[a - right:a - left + window]) if width > 1 else digits[-1])
                        places.append(a)
                        lows.append(left)
                        highs.append(right)
                        dones.append(d)
                lows, highs = np.array(lows, np.int64), np.array(highs, np.int64)
                whole = np.array(wholes, np.uint64) ^ mix64((lows << OFFSET_BITS | highs).astype(np.uint64) + np.uint64(1))
                packed = _packed(np.array(places, np.int64), lows, highs, np.array(dones, np.int64), int(tag[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(digits, np.uint64).view(np.int64)), pa.array(whole.view(np.int64)),
                                                  pa.array(np.full(len(packed), key.as_py())), pa.array(packed)],
                                                 ["digit", "whole", "text_key", "run"])
    return run


def _cut(window: int):
    """(text_key, tag, copies, text, runs) -> with the repeated spans and what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # small batches of whole texts
                part = batch.slice(i, 256)
                spans, kept = [], []
                for copies, text, runs in zip(part.column(2), part.column(3), part.column(4), strict=True):
                    data = text.as_buffer().to_pybytes()
                    if copies.as_py() > 1 and len(data) >= window:
                        mine = [(0, len(data))]
                    elif runs.is_valid:
                        place, low, high, _, _ = _unpacked(runs.values.to_numpy())
                        order = np.argsort(place - high, kind="stable")
                        start, end = (place - high)[order], np.maximum.accumulate((place - low)[order] + window)
                        new = np.flatnonzero(start[1:] > end[:-1]) + 1
                        mine = list(zip(start[np.concatenate([[0], new])].tolist(), end[np.concatenate([new, [len(end)]]) - 1].tolist(), strict=True))
                    else:
                        mine = []
                    at, left = 0, []
                    for s, e in mine:
                        left.append(data[at:s])
                        at = e
                    kept.append(b"".join([*left, data[at:]]))
                    spans.append([{"start": s, "end": e} for s, e in mine])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["text_key", "tag", "text", "spans", "kept"])
    return run


def _pass(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One digit: (runs found to repeat, runs of buckets that the next digit must
    split). ``records`` may be computed twice."""
    done = F.col("run").bitwiseAND(F.lit(1 << TAG_BITS)) != 0
    # Written first: as a plain side of the join it lets a hot bucket's records be split over tasks.
    buckets = scratch.keep(
        records.groupBy("digit").agg(F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"),
                                     F.min(done).alias("all_done"))
        .filter("n > 1 and not all_done").select("digit", (F.col("lo") == F.col("hi")).alias("equal")))
    met = scratch.keep(records.join(buckets, "digit").withColumn("done", done))
    mixed = met.filter("not equal")
    classes = scratch.keep(mixed.groupBy("digit", "whole").agg(
        F.count("*").alias("n"), F.max("done").alias("done"), F.min(F.struct("text_key", "run")).alias("r")))
    again = classes.filter("n > 1").select("digit", "whole")
    found = scratch.keep(met.filter("equal and not done").select("text_key", "run").unionByName(
        mixed.filter("not done").join(again, ["digit", "whole"], "left_semi").select("text_key", "run")))
    left = scratch.keep(classes.select("r.text_key", F.when(F.expr("n > 1 or done"), F.col("r.run").bitwiseOR(F.lit(1 << TAG_BITS)))
                                       .otherwise(F.col("r.run")).alias("run")))
    scratch.release(buckets, met, classes)
    return found, left


def _by_text(runs: DataFrame) -> DataFrame:
    """One row per text: its own runs, bounded by its length."""
    return (runs.withColumn("tag", F.col("run").bitwiseAND(F.lit(TAGS - 1)).cast("int"))
            .groupBy("text_key", "tag").agg(F.collect_list("run").alias("runs")))


def strip_repeats(docs: DataFrame, window: int = WINDOW, columns: dict[str, Column] | None = None, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> one row per input row: ``doc_id`` and, by
    default, ``spans`` (array of start, end in UTF-8 bytes: the maximal removed
    runs) and ``kept`` (the remaining bytes). ``columns`` names others, computed
    once per distinct text from ``text`` (its bytes), ``spans`` and ``kept``.

    A byte goes if a string of ``window`` bytes that covers it starts also anywhere
    else, in the same text or another; overlaps count. Strings are judged on the
    input and never reach over two texts. Null texts are empty; texts shorter than
    ``window`` lose nothing. Rows that repeat a text, with the same doc_id, another
    or none, repeat each other. Only doc_id and text are read, so further columns
    cannot clash. An empty table gives no rows. ``window`` is at least gram + 8 and
    at most 1,000; ``gram`` a multiple of 8.
    """
    if not gram + 8 <= window <= 1000 or gram % 8:
        raise ValueError("window must be from gram + 8 to 1,000, gram a multiple of 8")
    spark = docs.sparkSession
    columns = columns or {"spans": F.col("spans"), "kept": F.col("kept")}
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       F.pmod(F.xxhash64(F.lit(1), text), F.lit(TAGS)).cast("int").alias("tag"), text.cast("binary").alias("text"))
    # Distinct texts, bucketed by their key: every later pass meets them without moving them again.
    name = f"distinct_texts_{uuid.uuid4().hex}"
    (rows.groupBy("text_key", "tag").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
     .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "text_key", "tag").saveAsTable(name))
    try:
        texts = spark.read.table(name)
        found, left = _pass(texts.select("text_key", "tag", "copies", "text").mapInArrow(_first_digit(window, gram), RECORD), scratch)
        cover = [found]
        for width in CELLS:
            if not left.limit(1).count():
                break
            cells = scratch.keep(texts.join(_by_text(left), ["text_key", "tag"]).select("text_key", "text", "runs")
                                 .mapInArrow(_next_digit(window, width), RECORD))
            scratch.release(left)
            found, left = _pass(cells, scratch)
            scratch.release(cells)
            cover.append(found)
        runs = cover[0]
        for more in cover[1:]:
            runs = runs.unionByName(more)
        stripped = (texts.join(_by_text(runs), ["text_key", "tag"], "left").select("text_key", "tag", "copies", "text", "runs")
                    .mapInArrow(_cut(window), "text_key bigint, tag int, text binary, spans array<struct<start:bigint,end:bigint>>, kept binary"))
        return written(rows.select("doc_id", "text_key", "tag")
                       .join(stripped.select("text_key", "tag", *[c.alias(n) for n, c in columns.items()]), ["text_key", "tag"])
                       .select("doc_id", *columns))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.release()
