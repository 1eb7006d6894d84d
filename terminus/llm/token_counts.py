"""Token counts by a two-tier lookup on the map side.

Tier 1 is a table ``pre-token -> number of tokens`` of the most frequent
pre-tokens, broadcast to all workers; its size is a parameter and does not grow
with the corpus. It comes from one pass over all texts in which every task
keeps a bounded Misra-Gries summary; only the summaries (at most ``frequent``
rows a task) are added up. Tier 2 is a bounded cache in each worker that
encodes every miss with the tokenizer's own model. Pre-tokens are never
shuffled, and neither are texts. The counts do not depend on the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.tokens import LONGEST_CACHED, Lookup, Pretokens

TOKENIZER = "byte_bpe_50k.json"
FREQUENT = 16_384
LIMIT = 512


def _pruned(counts: Counter, size: int) -> Counter:
    """Misra-Gries step: subtract the (size+1)-th count from all."""
    if len(counts) <= size:
        return counts
    floor = sorted(counts.values(), reverse=True)[size]
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def _summaries(tokenizer: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, counts = Pretokens(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0):
                for part, special in pre.parts(text.as_py()):
                    if special is None:
                        counts.update(pre.split(part))
                if len(counts) > 8 * size:
                    counts = _pruned(counts, size)
        top = [(k, v) for k, v in _pruned(counts, size).items() if len(k) <= LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()),
                                          pa.array([v for _, v in top], pa.int64())], ["piece", "n"])
    return run


def frequent_lengths(texts: DataFrame, tokenizer: str, size: int) -> dict[str, int]:
    """The ``size`` most frequent pre-tokens of ``texts(text)`` -> token count."""
    top = (texts.filter("text is not null").select("text")
           .mapInArrow(_summaries(tokenizer, size), "piece string, n bigint")
           .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size))
    pre = Pretokens(tokenizer)
    return {r.piece: len(pre.encode(r.piece)) for r in top.select("piece").collect()}


def _counted(tokenizer: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = Pretokens(tokenizer)
        lookup = Lookup(lambda piece: len(pre.encode(piece)), shared.value).__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(sum(sum(map(lookup, pre.split(part))) if special is None else 1
                                    for part, special in pre.parts(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT,
                 frequent: int = FREQUENT) -> DataFrame:
    """``docs(doc_id, text, ..)`` -> ``doc_id, n_bytes, n_tokens, over_limit``,
    one row per input row.

    Counts are the library's for the whole text without begin or end tokens; a
    special string inside a text is one token. Null and empty texts have 0 bytes
    and 0 tokens. Null or repeated doc_ids pass through. Only doc_id and text
    are read, so further columns cannot clash. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, tokenizer, frequent))
    return (texts.mapInArrow(_counted(tokenizer, shared), "doc_id bigint, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit))
