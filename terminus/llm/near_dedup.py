"""MinHash near-duplicate removal with SuperMinHash signatures.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's
set holds its distinct five-word shingles (with fewer words the whole sequence
as one). Shingles are carried as 64-bit hashes.

1. *Signatures.* SuperMinHash gives every element one random permutation of the
   ``m`` slots and takes ``rank + r`` as its value in the slot that it visits at
   that rank. Slots reached at a lower rank always win, so ranks are processed
   one by one, vectorised over all elements of a batch, and a document stops as
   soon as all its slots are filled (early stopping).
2. *Classes.* Documents with equal sets form one class; only classes go on, so
   thousands of exact copies count as one row.
3. *Banding.* ``bands`` keys of ``rows`` slots each. With 30 x 4 slots a pair
   at similarity 0.75 shares no key with probability 1.1e-5.
4. *Verification* on full sets, without listing all pairs of a bucket. First
   every class against its bucket's smallest class (a bucket has 30 chances to
   have another leader, so a group of thousands of near copies is one component
   after this turn). Then the members that are still in different components:
   most of them share too few shingles with all others together to have any
   link, which one count of the shingles shows; the pairs of those that remain
   are compared one by one. There is no cap.
5. *Union-find grouping* of the confirmed links (components.py).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import Memo, Scratch, mix64, released, written
from terminus.llm.components import components

SHINGLE_WORDS = 5
THRESHOLD_PCT = 75
BANDS, ROWS = 30, 4
BLOCK_ELEMENTS = 1 << 18
REFUTE_TURNS = 2
MARKS = 1 << 26
EMPTY_SLOT = np.uint64(0xFFFFFFFFFFFFFFFF)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORD_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 300_000)


def shingle_set(text: str | None, memo: Memo, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one text (empty without words)."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    span = min(k, len(words))
    n = len(words) - span + 1
    acc = h[:n].copy()
    for j in range(1, span):
        acc *= WORD_FACTOR
        acc += h[j:j + n]
    return np.unique(mix64(acc + np.uint64(span)))


def super_minhash(values: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """Signatures ``(n_sets, m)`` of the sets given by ``values``/``owner``.

    A slot holds ``rank << 32 | r``; sets without elements keep EMPTY_SLOT.
    """
    sig = np.full(n_sets * m, EMPTY_SLOT)
    base = owner.astype(np.int64) * m
    perm = None
    for rank in range(m):
        rnd = mix64(values + np.uint64((int(GOLDEN) * (rank + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = (rank + (rnd >> np.uint64(32)) % np.uint64(m - rank)).astype(np.int64)
        value = (np.uint64(rank) << np.uint64(32)) | (rnd & np.uint64(0xFFFFFFFF))
        if perm is None:
            slot = pick
        else:
            at = np.arange(len(values))
            slot = perm[at, pick]
            perm[at, pick] = perm[:, rank]
        np.minimum.at(sig, base + slot, value)
        open_sets = (sig.reshape(n_sets, m) == EMPTY_SLOT).any(axis=1)
        live = open_sets[owner]
        if not live.any():
            break
        if perm is None:
            values, owner, base, pick = values[live], owner[live], base[live], pick[live]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(values), 1))
            perm[np.arange(len(values)), pick] = 0
        elif not live.all():
            values, owner, base, perm = values[live], owner[live], base[live], perm[live]
    return sig.reshape(n_sets, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    acc = np.tile(np.arange(bands, dtype=np.uint64) * GOLDEN, (len(sig), 1))
    for j in range(rows):
        acc = mix64(acc + parts[:, :, j])
    return acc.view(np.int64)


def _signed(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                sets, total, first = [], 0, at
                while at < len(ids) and total < BLOCK_ELEMENTS:
                    sets.append(shingle_set(texts[at].as_py(), memo, k))
                    total += len(sets[-1])
                    at += 1
                sizes = np.array([len(s) for s in sets])
                sig = super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes),
                                    len(sets), bands * rows)
                keys = band_keys(sig, bands, rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[first:at], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r if n else [] for r, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "digest", "bands"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([shingle_set(t, memo, k).tobytes() for t in part.column(1).to_pylist()],
                                              pa.binary())], ["rep", "shingles"])
    return run


def _overlap(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold_pct * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    # ``b`` first: the leaders, of which one may have very many members, come by a
    # join whose both sides are shuffled and so can be split.
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
            .mapInArrow(released(_overlap(threshold_pct)), "a bigint, b bigint"))


def _marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows whose key is in ``wanted``, and by chance some others: a bitmap of
    ``MARKS`` bits, 8 MB whatever the number of keys, is broadcast, so that most
    rows that a semi-join would drop are not shuffled for it."""
    def place(c: str):
        return F.pmod(F.xxhash64(c), F.lit(MARKS))

    pages = (wanted.groupBy(F.bitmap_bucket_number(place(wanted_key)).alias("_page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(wanted_key))).alias("_bits")))
    bit = F.bitmap_bit_position(place(key)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_page", F.bitmap_bucket_number(place(key))).join(F.broadcast(pages), "_page")
            .filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(rows.columns))


def _pairs(groups: DataFrame) -> DataFrame:
    """Every member with its group's leader: linear in the members."""
    return groups.filter("rep <> lead").select(F.least("lead", "rep").alias("a"),
                                               F.greatest("lead", "rep").alias("b")).distinct()


def _open(members: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """Members that a turn of leader pairs leaves undecided: those of buckets in
    which the others than the leader are still in different components.
    ``smallest`` is the size of the bucket's smallest set."""
    others = scratch.keep(members.filter("rep <> lead").join(label.withColumnRenamed("node", "rep"), "rep", "left")
                     .select("key", "cls", "rep", "n", F.coalesce("component", "rep").alias("comp")))
    mixed = (others.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("smallest"))
             .filter("lo <> hi").select("key", "smallest"))
    open_ = scratch.keep(others.join(mixed, "key"))
    scratch.release(others)
    return open_


def _possible(open_: DataFrame, sets: DataFrame, threshold_pct: int, scratch: Scratch) -> DataFrame:
    """The open members that can have a link at all, with a ``prefix``.

    Two sets of n and m share at least t / (1 + t) * (n + m) shingles. A member of
    which fewer shingles occur in any other open member than its smallest partner
    asks for has no link. For the others, with their common shingles ordered from
    rare to frequent, linked members share one among their first (common - asked
    + 1). Linear in the shingles of the open members, and exact.
    """
    asks = open_.groupBy("rep").agg(F.min("n").alias("n"), F.min("smallest").alias("smallest"))
    each = sets.join(asks.select("rep"), "rep", "left_semi").mapInArrow(released(_exploded), "rep bigint, shingle bigint")
    shared = (each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
              .filter("lo <> hi").select("shingle", "df"))
    common = each.join(shared, "shingle").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("common"))  # one member's own shingles
    asked = F.ceil(threshold_pct * (F.col("n") + F.col("smallest")) / F.lit(100 + threshold_pct) - 1e-9)
    able = (asks.join(common, "rep").withColumn("spare", F.size("common") - asked).filter("spare >= 0")
            .select("rep", F.size("common").alias("n_common"), F.slice("common.shingle", F.lit(1), (F.col("spare") + 1).cast("int")).alias("prefix")))
    return scratch.keep(open_.drop("prefix", "n_common").join(able, "rep"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(raw.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), rep)), pa.array(values)], ["rep", "shingle"])


def _rest(open_: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs of open members in different components, each at the first open key
    that both have. Left out are pairs whose sizes, common shingles or prefixes rule
    a link out; all three rules are exact."""
    keys = open_.groupBy("rep", "cls").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # at most ``bands``
    full = open_.join(keys, ["rep", "cls"])
    x, y = full.alias("x"), full.alias("y")
    first = F.element_at(F.array_intersect("x.keys", "y.keys"), 1)
    return (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep"))
                   & (F.col("x.comp") != F.col("y.comp"))
                   & (100 * F.least("x.n", "y.n") >= threshold_pct * F.greatest("x.n", "y.n"))
                   & ((100 + threshold_pct) * F.least("x.n_common", "y.n_common") >= threshold_pct * (F.col("x.n") + F.col("y.n")))
                   & F.arrays_overlap("x.prefix", "y.prefix") & (first == F.col("x.key")))
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, threshold_pct: int = THRESHOLD_PCT, shingle_words: int = SHINGLE_WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> one row per input row: ``doc_id,
    n_shingles, component_id, kept``.

    Null or blank texts have an empty set and are linked with nothing. A row
    without a doc_id is never linked: its component_id is null and it is kept.
    Rows that repeat a doc_id share its component. Only doc_id and text are
    read, so further columns cannot clash. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.mapInArrow(
        released(_signed(bands, rows, shingle_words)), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"))
    linkable = signed.filter("n_shingles > 0 and doc_id is not null")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    classes = scratch.keep(linkable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    # Only classes whose smallest doc_id repeats with another set need ``cls`` to be told apart.
    buckets = classes.select(F.explode("bands").alias("key"), F.xxhash64("digest").alias("cls"), "rep", "n")
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    members = scratch.keep(buckets.join(shared, "key").select("key", "cls", "rep", "n", "lead"))

    reps = members.select("rep").distinct()
    texts_once = _marked(texts.filter("doc_id is not null and text is not null"), "doc_id", reps, "rep")
    # A doc_id that occurs with several texts has several sets: the digest picks the right one.
    # (An inner join with distinct reps: a semi-join would be pushed below the bitmap.)
    # Bucketed by rep: the turns below meet the sets without moving them again.
    name = f"shingle_sets_{uuid.uuid4().hex}"
    (texts_once.join(reps, texts_once["doc_id"] == reps["rep"]).select("doc_id", "text")
     .mapInArrow(released(_sets(shingle_words)), "rep bigint, shingles binary")
     .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep").saveAsTable(name))
    try:
        sets = spark.read.table(name)
        found = scratch.keep(_verified(_pairs(members), sets, threshold_pct))
        open_ = _open(members, components(found), scratch)
        for _ in range(REFUTE_TURNS):
            before, open_ = open_, _possible(open_, sets, threshold_pct, scratch)
            scratch.release(before)
        more = _verified(_rest(open_, threshold_pct), sets, threshold_pct)
        of_set = linkable.select("digest", "doc_id").distinct().join(classes.select("digest", "rep"), "digest")
        same_id = of_set.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        label = components(found.union(more).union(same_id))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.release()
    return (signed.select("doc_id", "n_shingles")
            .join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay: one per group. Of several rows with one
    doc_id the smallest (by all columns) stays."""
    groups = near_duplicates(docs, **params)
    gone = groups.filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    twice = written(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    once = left.join(twice, "doc_id", "left_anti").select(docs.columns)
    chosen = (left.join(twice, "doc_id", "left_semi").select(docs.columns)
              .groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return once.unionByName(chosen)
