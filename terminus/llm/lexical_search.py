"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt into shards of at most ``SHARD_DOCS`` documents (and
``SHARD_TOKENS`` query-term occurrences), where they are read: no posting ever
moves. A shard builds one impact list per query term, sorted by impact. For an
item, all its lists are read in parallel from the top. A document met in any
list is scored at once by direct access to the others. Every list has a *best
position*: the end of its leading run of documents that were seen, by reading
or by direct access. What stands behind the best positions bounds the score of
every unseen document, and this bound is tighter than the one at the last-read
positions. Reading stops when the bound is strictly below the k-th score, so
equal scores are never lost.

The k-th score is carried from shard to shard of a task. A task returns ``top``
rows per item; the best of them are chosen by a window with a limit.

The items come in blocks of at most ``BLOCK_TERMS`` (item, term) rows (one item
more), and each block is one pass over the documents for the statistics of its
terms and one for the search. Only such a block is held in the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terminus.llm.common import written
from terminus.llm.running import prefix_sums

TOP = 20
BLOCK_TERMS = 200_000
SHARD_DOCS = 8192
SHARD_TOKENS = 4_000_000
DENSE_VALUES = 1 << 24
FIRST_READ = 64
# ASCII letters and digits and all bytes of longer characters belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(terms(text))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                                                  pa.array(list(found.values()), pa.int64())], ["item_id", "term", "qtf"])


def _statistics(vocabulary):
    """Per task: one row per vocabulary term with its df, and one with a null
    term that holds the documents with terms and their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df, docs, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                words = terms(text.as_py())
                docs += bool(words)
                total += len(words)
                df.update(known.keys() & set(words))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([docs, *df.values()], pa.int64()),
                                          pa.array([total] + [0] * len(df), pa.int64())], ["term", "df", "total"])
    return run


class Shard:
    """Impact lists of some documents for the terms of a query block."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int):
        size = len(lengths)
        key, tf = np.unique(term.astype(np.int64) * size + doc, return_counts=True)
        term, doc = key // size, key % size
        m = 75 + (25 * lengths.astype(np.int64) * n_docs) // max(n_terms, 1)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.lexsort((-impact, term))
        self.size, self.doc, self.impact = size, doc[order], impact[order]
        self.known, first = np.unique(term, return_index=True)
        self.edges = np.append(first, len(term))
        self.dense: dict[int, np.ndarray] = {}

    def list_of(self, term: int) -> slice:
        at = int(np.searchsorted(self.known, term))
        if at == len(self.known) or self.known[at] != term:
            return slice(0, 0)
        return slice(int(self.edges[at]), int(self.edges[at + 1]))

    def direct(self, term: int, where: slice) -> np.ndarray:
        """The term's impact by document, for direct access; rows are kept for
        other items as long as they fit ``DENSE_VALUES``."""
        if term not in self.dense:
            if len(self.dense) * self.size >= DENSE_VALUES:
                self.dense.clear()
            row = np.zeros(self.size, np.int32)
            row[self.doc[where]] = self.impact[where]
            self.dense[term] = row
        return self.dense[term]


def best_positions(shard: Shard, query: list[tuple[int, int]], top: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents (by their number in the shard) and scores that can be among the
    ``top``: all whose score is not strictly below the k-th. ``query`` holds
    (term, weight); ``floor`` the scores, highest first, known from elsewhere."""
    lists = [(shard.list_of(t), t, u) for t, u in query if u > 0]
    lists = [(shard.doc[s], shard.impact[s], shard.direct(t, s), u) for s, t, u in lists if s.stop > s.start]
    seen = np.zeros(shard.size, bool)
    best = [0] * len(lists)  # first position not known to be seen
    found, scores, at, step = [], [], 0, FIRST_READ
    while True:
        read = [docs[at:at + step] for docs, _, _, _ in lists]
        new = np.unique(np.concatenate(read)) if read else np.empty(0, np.int64)
        new = new[~seen[new]]
        seen[new] = True
        if len(new):
            score = np.zeros(len(new), np.int64)
            for _, _, direct, u in lists:
                score += u * direct[new].astype(np.int64)
            found.append(new)
            scores.append(score)
            floor = np.sort(np.concatenate([floor, score]))[::-1][:top]
        at, step = at + step, step * 2
        bound = 0
        for i, (docs, impact, _, u) in enumerate(lists):
            gap = np.flatnonzero(~seen[docs[best[i]:]])
            best[i] = best[i] + int(gap[0]) if len(gap) else len(docs)
            bound += u * int(impact[best[i]]) if best[i] < len(docs) else 0
        if bound == 0 or (len(floor) >= top and bound < floor[top - 1]):
            break
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    docs, score = np.concatenate(found), np.concatenate(scores)
    keep = (score > 0) & (score >= (floor[top - 1] if len(floor) >= top else 0))
    return docs[keep], score[keep]


def _search(block, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, queries, n_docs, n_terms = block.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        none = np.empty(0, np.int64)

        def search(ids: list, lengths: list, found: list) -> None:
            if not ids:
                return
            doc = np.repeat(np.arange(len(ids)), [len(f) for f in found])
            shard = Shard(np.concatenate(found), doc, np.array(lengths, np.int64), n_docs, n_terms)
            missing = np.array([i is None for i in ids])
            names = np.array([0 if i is None else i for i in ids], np.int64)
            for item, query in enumerate(queries):
                name, null, score = kept.get(item, (none, none.astype(bool), none))
                docs, more = best_positions(shard, query, top, score)
                if len(docs):
                    name, null = np.concatenate([name, names[docs]]), np.concatenate([null, missing[docs]])
                    score = np.concatenate([score, more])
                    best = np.lexsort((name, null, -score))[:top]
                    kept[item] = name[best], null[best], score[best]

        get = numbers.get
        ids, lengths, found, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                hits = [x for x in map(get, words) if x is not None]
                if not hits:
                    continue
                ids.append(doc_id.as_py())
                lengths.append(len(words))
                found.append(np.array(hits, np.int64))
                held += len(hits)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    search(ids, lengths, found)
                    ids, lengths, found, held = [], [], [], 0
        search(ids, lengths, found)
        for item, (name, null, score) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(name), pa.int64()), pa.array(name, pa.int64(), mask=null),
                                              pa.array(score, pa.int64())], ["item", "doc_id", "score"])
    return run


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``docs(doc_id, text, ..)``, ``items(item_id, text, ..)`` -> ``item_id,
    rank, doc_id, score``: the ``top`` highest scores above 0 of each item, equal
    ones by ascending doc_id (null last).

    Every row of ``docs`` is a document, also if its doc_id repeats or is null.
    Null and blank texts have no term: they count for nothing and are never
    returned. Rows that share an item_id are one item with the terms of its
    distinct texts; items with a null item_id or without terms return nothing.
    Only these columns are read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = written(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
                    .filter("item_id is not null").distinct()
                    .mapInArrow(_query_terms, "item_id bigint, term binary, qtf bigint")
                    .groupBy("item_id", "term").agg(F.sum("qtf").alias("qtf")))
    per_item = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    blocks = written(prefix_sums(per_item, [F.col("item_id")], {"before": F.col("n")})
                     .select("item_id", F.floor(F.col("before") / block_terms).alias("block")))
    asked = asked.join(blocks, "item_id")
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in [r["block"] for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]:
        rows = asked.filter(F.col("block") == block).select("item_id", "term", "qtf").collect()  # at most block_terms and one item
        out = out.unionByName(_block(texts, rows, top))
    return out


def _block(texts: DataFrame, rows: list, top: int) -> DataFrame:
    spark = texts.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    items = sorted({r["item_id"] for r in rows})
    stats = (texts.select("text").mapInArrow(_statistics(spark.sparkContext.broadcast(numbers)), "term binary, df bigint, total bigint")
             .groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
    df, n_docs, n_terms = np.zeros(len(numbers), np.int64), 0, 0
    for r in stats.collect():  # one row per term of the block
        if r["term"] is None:
            n_docs, n_terms = r["df"], r["total"]
        else:
            df[numbers[bytes(r["term"])]] = r["df"]
    w = weight(n_docs, df)
    number_of = {item: i for i, item in enumerate(items)}
    queries: list[list[tuple[int, int]]] = [[] for _ in items]
    for r in rows:
        t = numbers[bytes(r["term"])]
        queries[number_of[r["item_id"]]].append((t, int(w[t]) * r["qtf"]))
    block = spark.sparkContext.broadcast((numbers, queries, n_docs, n_terms))
    found = texts.mapInArrow(_search(block, top), "item bigint, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items)), "item bigint, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # as many names as the block has


def oracle_sql() -> str:
    return r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
held AS (SELECT row_id, doc_id, words, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
totals AS (SELECT count(*)::HUGEINT AS n_docs, sum(n)::HUGEINT AS n_terms FROM held),
tf AS (SELECT row_id, doc_id, n, term, count(*)::HUGEINT AS tf
       FROM (SELECT row_id, doc_id, n, unnest(words) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::HUGEINT AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
scores AS (
  SELECT a.item_id, t.row_id, t.doc_id,
         sum(a.qtf * floor(1000 * ln((2 * s.n_docs + 2)::DOUBLE / (2 * df.df + 1)::DOUBLE))::HUGEINT
             * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * t.n * s.n_docs) // s.n_terms)))) AS score
  FROM asked a JOIN tf t USING (term) JOIN df USING (term) CROSS JOIN totals s
  GROUP BY a.item_id, t.row_id, t.doc_id),
ranked AS (SELECT item_id, doc_id, score,
                  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM ranked WHERE rank <= 20
"""
