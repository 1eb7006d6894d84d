"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all ways to write it as a sequence of
pieces (forward algorithm); a text's is the product over its words. Words are
runs of letters and marks, lower-cased, with the vocabulary's word-start mark in
front; digits and punctuation say nothing about the language. A letter without
a piece of its own uses one reserved piece.

Fitting: expectation maximisation. The labelled rows are bounded: about
``sample`` per language, chosen by a hash of doc_id. Their word counts are one
small table; each round sums expected piece counts (forward-backward) over it,
at most vocabulary x languages numbers a task and in total. Prediction reads
every text whole, on the map side, with a bounded word cache in each worker.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import free_memory, released, written
from terminus.llm.tokens import tokenizer_file

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
UNDETERMINED = "und"
SAMPLE = 3000       # labelled rows per language, about
ROUNDS = 3          # of expectation maximisation
SMOOTHING = 0.05    # added to every expected count
CACHE = 200_000     # words
FACTOR = 0x9E3779B97F4A7C15
MARK_BITS = 18
LONG = 60           # letters from which sums are taken in logarithms
CHUNK = 200_000     # words scored at once
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTERS_ONLY = regex.compile(rf"{START}?[\p{{L}}\p{{M}}]+|{START}")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower())


class Pieces:
    """Piece ids of the vocabulary; id 0 is the reserved piece."""

    def __init__(self, name: str = VOCABULARY):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        found = sorted({p for p in map(sp.id_to_piece, range(sp.get_piece_size()))
                        if LETTERS_ONLY.fullmatch(p) and p == p.lower()})
        self.ids = {p: i + 1 for i, p in enumerate(found)}
        self.size = len(found) + 1
        self.longest = max(map(len, found))
        # Per length: the pieces' hashes in order, their ids, and marks of some hash
        # bits, which most strings that are no piece do not hit.
        self.by_length = {}
        for k in range(1, self.longest + 1):
            mine = sorted((self._hash(p), self.ids[p]) for p in found if len(p) == k)
            hashes = np.array([h for h, _ in mine], np.uint64)
            marks = np.zeros(1 << MARK_BITS, bool)
            marks[hashes >> np.uint64(64 - MARK_BITS)] = True
            self.by_length[k] = hashes, np.array([i for _, i in mine], np.int32), marks

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * FACTOR + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]) -> np.ndarray:
        """Words of one length n -> ids (word, end, piece length), -1: no piece.
        Pieces are found by 64-bit hashes of all substrings, a length at a time."""
        n = len(words[0]) + 1
        wide = min(self.longest, n)
        letters = "".join(START + w for w in words).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(letters, "<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out = np.full((len(words), n, wide), -1, np.int32)
        h, power = np.zeros_like(codes), 1
        for k in range(1, wide + 1):
            h[:, k - 1:] += codes[:, :n - k + 1] * np.uint64(power)
            power = power * FACTOR & 0xFFFFFFFFFFFFFFFF
            hashes, ids, marks = self.by_length[k]
            if not len(hashes):
                continue
            word, at = marks[h[:, k - 1:] >> np.uint64(64 - MARK_BITS)].nonzero()
            found = h[word, at + k - 1]
            where = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = hashes[where] == found
            out[word[hit], at[hit] + k - 1, k - 1] = ids[where[hit]]
        out[:, :, 0] = np.maximum(out[:, :, 0], 0)
        return out


def _forward(ids: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums. ``prob`` (pieces + 1, languages), last row 0 (for id
    -1). Returns alpha (end, word, language), each end divided by a scale, and
    the summed logs of the scales up to that end (so long words do not underflow)."""
    w, n, wide = ids.shape
    langs = prob.shape[1]
    alpha = np.zeros((n + 1, w, langs))
    scale = np.zeros((n + 1, w, langs))
    alpha[0] = 1
    for end in range(1, n + 1):
        total = np.zeros((w, langs))
        for k in range(1, min(wide, end) + 1):
            term = alpha[end - k] * prob[ids[:, end - 1, k - 1]]
            total += term * np.exp(scale[end - k] - scale[end - 1]) if n > 24 else term
        if n > 24:
            alpha[end] = 1
            scale[end] = scale[end - 1] + np.log(total)
        else:
            alpha[end] = total
    return alpha, scale


def log_word_probs(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word) per language, all segmentations summed."""
    out = np.empty((len(words), prob.shape[1]))
    at = defaultdict(list)
    for i, w in enumerate(words):
        at[len(w)].append(i)
    for where in at.values():
        step = max(1, min(4096, 400_000 // (len(words[where[0]]) + 1)))  # bounded arrays for long runs
        for lo in range(0, len(where), step):
            part = where[lo:lo + step]
            alpha, scale = _forward(pieces.lattice([words[i] for i in part]), prob)
            out[part] = np.log(alpha[-1]) + scale[-1]
    return out


def _long_counts(ids: np.ndarray, p: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """``expected_counts`` of long words: the same sums in logarithms."""
    w, n, wide = ids.shape
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    ahead, behind = np.full((n + 1, w), -np.inf), np.full((n + 1, w), -np.inf)
    ahead[0] = behind[n] = 0
    for end in range(1, n + 1):
        for k in range(1, min(wide, end) + 1):
            ahead[end] = np.logaddexp(ahead[end], ahead[end - k] + log_p[ids[:, end - 1, k - 1]])
    for end in range(n, 0, -1):
        for k in range(1, min(wide, end) + 1):
            behind[end - k] = np.logaddexp(behind[end - k], behind[end] + log_p[ids[:, end - 1, k - 1]])
    for end in range(1, n + 1):
        for k in range(1, min(wide, end) + 1):
            piece = ids[:, end - 1, k - 1]
            np.add.at(out, piece, np.exp(ahead[end - k] + log_p[piece] + behind[end] - ahead[n]) * weight)


def expected_counts(pieces: Pieces, prob: np.ndarray, words: list[str], weight: np.ndarray, long: int = LONG) -> np.ndarray:
    """Expected uses of each piece (forward-backward) in words counted ``weight``
    times; ``prob`` (pieces + 1, 1) of one language."""
    out = np.zeros(len(prob))
    at = defaultdict(list)
    for i, w in enumerate(words):
        at[len(w)].append(i)
    for where in at.values():
        step = max(1, min(2048, 400_000 // (len(words[where[0]]) + 1)))
        for lo in range(0, len(where), step):
            part = where[lo:lo + step]
            ids = pieces.lattice([words[i] for i in part])
            w, n, wide = ids.shape
            p = prob[:, 0]
            if n > long:
                _long_counts(ids, p, weight[part], out)
                continue
            alpha = np.zeros((n + 1, w))
            beta = np.zeros((n + 1, w))
            alpha[0] = beta[n] = 1
            for end in range(1, n + 1):
                for k in range(1, min(wide, end) + 1):
                    alpha[end] += alpha[end - k] * p[ids[:, end - 1, k - 1]]
            for end in range(n, 0, -1):
                for k in range(1, min(wide, end) + 1):
                    beta[end - k] += beta[end] * p[ids[:, end - 1, k - 1]]
            share = weight[part] / np.maximum(alpha[n], 1e-300)
            for end in range(1, n + 1):
                for k in range(1, min(wide, end) + 1):
                    piece = ids[:, end - 1, k - 1]
                    np.add.at(out, piece, alpha[end - k] * p[piece] * beta[end] * share)
    out[-1] = 0
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[lang].update(words_of(text.as_py()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                          enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _expect(vocabulary: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob = model.value
        pieces, total = Pieces(vocabulary), np.zeros_like(prob)
        for batch in batches:
            lang, word = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for j, name in enumerate(langs):
                mine = np.flatnonzero(lang == name)
                total[:, j] += expected_counts(pieces, prob[:, j:j + 1], [word[i] for i in mine], n[mine])
        piece, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(j, pa.int64()),
                                          pa.array(total[piece, j])], ["piece", "j", "n"])
    return run


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE,
        rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """``labelled(doc_id, text, lang)``, lang and doc_id not null -> languages in
    order and piece probabilities (pieces + 1, languages), last row 0."""
    spark = labelled.sparkSession
    # Bounded by the number of languages.
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    langs = [r["lang"] for r in sizes]
    pieces = Pieces(vocabulary)
    prob = np.full((pieces.size + 1, len(langs)), 1 / pieces.size)
    prob[-1] = 0
    if not langs:
        return [], prob
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]))])
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    words = written(chosen.select("lang", "text").mapInArrow(released(_word_counts), "lang string, word string, n bigint")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((langs, prob))
        # Bounded by vocabulary x languages.
        got = (words.mapInArrow(released(_expect(vocabulary, model)), "piece bigint, j bigint, n double")
               .groupBy("piece", "j").agg(F.sum("n").alias("n")).orderBy("piece", "j").toPandas())
        counts = np.full(prob.shape, SMOOTHING)
        counts[got["piece"], got["j"]] += np.round(got["n"], 6)
        counts[-1] = 0
        prob = counts / counts.sum(axis=0)
        model.unpersist()
    return langs, prob


class Scorer:
    """Predictions for lists of texts, with a bounded cache of word scores."""

    def __init__(self, vocabulary: str, langs: list[str], prob: np.ndarray):
        self.langs, self.prob = langs, prob
        self.pieces, self.row = Pieces(vocabulary), {}
        self.scores = np.empty((CACHE, len(langs)))

    def _learn(self, texts: list[list[str]]) -> None:
        if len(self.row) > CACHE:
            self.row.clear()
        new = sorted(set().union(*texts).difference(self.row))
        first = len(self.row)
        if first + len(new) > len(self.scores):
            self.scores = np.resize(self.scores, (2 * (first + len(new)), len(self.langs)))
        if new:
            self.scores[first:first + len(new)] = log_word_probs(self.pieces, self.prob, new)
            self.row.update(zip(new, range(first, first + len(new)), strict=True))

    def _chunk(self, texts: list[list[str]]) -> Iterator[tuple[str, float]]:
        if self.langs:
            self._learn(texts)
        for words in texts:
            if not words or not self.langs:
                yield UNDETERMINED, 0.0
                continue
            total = self.scores[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            yield self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def __call__(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size > CHUNK:
                out += self._chunk(held)
                held, size = [], 0
        return out + list(self._chunk(held))


def _scored(vocabulary: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(vocabulary, *model.value)
        for batch in batches:
            out = score(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())],
                ["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``lang_pred, score`` to ``doc_id`` (one row per input row). ``und``
    with score 0: null text, no letter, or a model without languages. The score
    is the posterior of the language under a uniform prior."""
    model = docs.sparkSession.sparkContext.broadcast((langs, prob))
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(released(_scored(vocabulary, model)), "doc_id bigint, lang_pred string, score double"))


def training_rows(docs: DataFrame) -> DataFrame:
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
            .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                    & ~held_out(F.col("doc_id"))))


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, lang, ..)`` -> ``doc_id, held_out, lang_pred, score``,
    one row per input row.

    Learns only from rows with doc_id, text and lang that are not held out
    (crc32 of doc_id modulo 4 is 2); a null doc_id is not held out. Repeated
    rows are predicted alike. Other columns are never read. An empty table gives
    no rows; without any labelled row everything is ``und``.
    """
    langs, prob = fit(training_rows(docs), vocabulary, sample)
    return predict(docs, langs, prob, vocabulary).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _kept(vocabulary: str, model, least: float):
    @F.pandas_udf("boolean")
    def keep(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(vocabulary, *model.value)
        for part in texts:
            yield pd.Series([x != UNDETERMINED and s >= least for x, s in score(part)], dtype=bool)
        del score
        free_memory()
    return keep


def keep_identified(docs: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (all columns) with a language whose posterior is at
    least ``least``; rows without one (null text, no letter) go. Filtered where
    the text is read: no shuffle, and only the text goes to Python."""
    langs, prob = fit(training_rows(docs), vocabulary, sample)
    model = docs.sparkSession.sparkContext.broadcast((langs, prob))
    return docs.filter(_kept(vocabulary, model, least)(F.col("text").cast("string")))
