"""Main text of web pages: article markup, and a host suffix array for the rest.

*Parsing.* Each page becomes blocks of text in page order with what their
elements say about them: inside a menu, footer, sidebar, notice, advert, form or
reader comments (boilerplate), inside ``article``, ``main`` or a content
container, or nothing. Hidden elements, menus, footers, asides and controls are
boilerplate with all they hold. A form or a name says less, as it may be that of
a wrapper (``layout has-sidebar``): content inside counts again, with a part of a
name if it is more than the other content, with a whole name (``comments``) if
there is no other. Without content inside, a form or a part of a name is
boilerplate if it holds a single block with less than half of the text, and in an
article if it holds less than ``MOST`` of it.

*Host suffix array.* The token streams of a host's pages, all their blocks in page
order, are concatenated, the suffixes are put in order by prefix doubling up to
``MIN_TOKENS`` tokens, and suffixes of distinct pages that agree on them mark repeated
substrings (longer repeats are unions of those). A host of any size is dealt into
shards of about ``SHARD_TOKENS`` tokens (by the length of its html); a page is parsed
once and goes to its shard with its blocks. What only repeats across shards is found by
hashes of the windows, for the pages whose text hangs on it: those that the markup does
not decide, against all pages of their host. Blocks whose tokens are mostly covered are
boilerplate; unique runs stay.

*Decision.* Every page of every host goes through the suffix array, and its text is
made of the blocks that this leaves and of those in article markup. Then the
markup checks what it can: a page with article markup keeps all of it, repeated
or not, and nothing else (of nested or several ranks the highest that has half of
the marked text): on the given pages an article may well be a copy of another one,
and adverts and notices differ from page to page, so repetition alone takes
articles for boilerplate and adverts for text. Where a page has no such markup, or
``MOST`` of its text lies outside, what the suffix array left stays; so it does on
pages that would come out empty although they have text in forms or named elements.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terminus.llm.common import Memo, mix64, packed, written
from terminus.llm.near_dedup import _marked as maybe_wanted

MIN_TOKENS = 8
SHARD_TOKENS = 200_000
COVERED = 0.5
MOST = 0.75
#: Characters of html to a token, for the size of shards only.
CHARS = 6
#: Hashes of words, kept by the worker.
HASHES = Memo(xxhash.xxh3_64_intdigest, 300_000)

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
                  "section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside menu dialog button label fieldset".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article main section div table ul ol dl body blockquote aside nav footer header form td th".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                        "menubar toolbar".split())
NEVER_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie "
                        "cookies consent gdpr notice sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
                        "masthead comment comments disqus replies respond share sharing social related recommended "
                        "newsletter subscribe subscription signup login popup modal overlay pagination pager "
                        "widget toolbar banner".split())
CONTENT_NAMES = frozenset(("articlebody article-body article-content article-text post-content post-body entry-content "
                           "story-body main-content").split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|"""
                 r"""<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Za-z]+")

ARTICLE, MAIN, CONTENT, PLAIN, BOILER = 3, 2, 1, 0, -1


def _attrs(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTR.findall(raw)} if raw else {}


def _enter(name: str, raw: str, outer: tuple[int, bool, int, int], soft: list[tuple[int, bool, int, bool]]) -> tuple[int, bool, int, int]:
    """What holds inside an element: kind, whether it is boilerplate for sure, its
    innermost doubtful container (a place in ``soft``, or -1), and what content
    was found in: 0 nothing doubtful but forms, 1 a part of a name, 2 a whole one."""
    kind, never, inner, side = outer
    if never or name in NEVER or name == "header" and kind < CONTENT:
        return BOILER, True, -1, 0
    attrs = _attrs(raw)
    role = attrs.get("role", "").lower()
    label = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    if ("hidden" in attrs or attrs.get("aria-hidden") == "true" or role in NEVER_ROLES
            or re.search(r"display\s*:\s*none", attrs.get("style", ""))):
        return BOILER, True, -1, 0
    marked = {"article": ARTICLE, "main": MAIN}.get(role, {"article": ARTICLE, "main": MAIN}.get(name, PLAIN))
    if "articlebody" in attrs.get("itemprop", "").lower() or CONTENT_NAMES.intersection(label.split()):
        marked = max(marked, CONTENT)
    if marked > PLAIN and kind < CONTENT:
        return marked, False, -1, max(side, soft[inner][2]) if inner >= 0 else side
    level = -1
    if name not in ("html", "body", "main"):
        level = 2 if NEVER_NAMES.intersection(label.split()) else 1 if NEVER_NAMES.intersection(NAME.findall(label)) else (
            0 if name == "form" or role == "form" else -1)
    if level >= 0:
        soft.append((inner, kind >= CONTENT, max(level, soft[inner][2]) if inner >= 0 else level, level == 2))
        inner = len(soft) - 1
    return max(kind, marked), False, inner, side


def _resolved(found: list[tuple[tuple[int, bool, int, int], str]], soft: list[tuple[int, bool, int, bool]]) -> list[tuple[int, str]]:
    """Blocks with their kinds, once it is known how much text each container holds."""
    mass, held = [0] * len(soft), [0] * len(soft)
    page = content = 0
    for (kind, never, inner, _), text in found:
        if not never:
            page += len(text)
            content += len(text) if kind >= CONTENT else 0
            if inner >= 0:
                mass[inner] += len(text)
                held[inner] += 1
    for i in range(len(soft) - 1, -1, -1):  # containers come after those around them
        if soft[i][0] >= 0:
            mass[soft[i][0]] += mass[i]
            held[soft[i][0]] += held[i]
    out = []
    for i, (around, within, _, whole) in enumerate(soft):
        out.append(whole or around >= 0 and out[around] or (
            mass[i] <= MOST * content if within else held[i] < 2 and 2 * mass[i] < page))
    sides = [0, 0, 0]
    for (kind, never, inner, side), text in found:
        if kind >= CONTENT and not never and (inner < 0 or not out[inner]):
            sides[side] += len(text)
    counts = (True, sides[1] > sides[0], not sides[0] and not sides[1])
    got = [(BOILER if never or inner >= 0 and out[inner] or not counts[side] else kind, text)
           for (kind, never, inner, side), text in found]
    if all(k == BOILER for k, _ in got):  # empty although it may have text
        got = [(BOILER if never else PLAIN, text) for (_, never, _, _), text in found]
    return got


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each non-empty block in page order."""
    out: list[tuple[tuple[int, bool, int, int], str]] = []
    held: list[str] = []
    soft: list[tuple[int, bool, int, bool]] = []
    stack: list[tuple[str, tuple[int, bool, int, int]]] = []
    now = start = (PLAIN, False, -1, 0)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((now, text))
            held.clear()

    def close(depth: int) -> None:
        nonlocal now
        if any(n in BLOCK for n, _ in stack[depth:]):
            flush()
        del stack[depth:]
        now = stack[-1][1] if stack else start

    page, at = page or "", 0
    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        end, name, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if end:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                close(depth)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            if not raw.rstrip().endswith("/"):
                found = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = found.end() if found else len(page)
            if name not in ("svg", "math"):
                held.append(" ")
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, -1, -1):  # an open p, or an item's predecessor, ends here
                if stack[k][0] == "p" or stack[k][0] in SELF_CLOSING.get(name, ()):
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
            flush()
        if name in VOID:
            if name != "wbr":
                held.append(" ")
            continue
        inside = _enter(name, raw, now, soft)
        if inside != now:
            flush()
        stack.append((name, inside))
        now = inside
    flush()
    return _resolved(out, soft)


def decided(found: list[tuple[int, str]]) -> str | None:
    """The text by markup; None where a page has text but little or no markup to go by."""
    marked = sum(len(t) for k, t in found if k > PLAIN)
    plain = sum(len(t) for k, t in found if k == PLAIN)
    if plain > MOST * (marked + plain):
        return None
    for rank in (ARTICLE, MAIN, CONTENT):
        kept = [t for k, t in found if k >= rank]
        if 2 * sum(map(len, kept)) >= marked:
            return "\n".join(kept)
    return ""


def checked(found: list[tuple[int, str]], left: list[bool]) -> str:
    """The blocks that the suffix array has left, as far as the markup agrees with it."""
    by_markup = decided(found)
    return "\n".join(t for (_, t), stays in zip(found, left, strict=True) if stays) if by_markup is None else by_markup


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a page's stream, all blocks in page order, and their block."""
    words = [t.split() for t in texts]
    n = [len(w) for w in words]
    return (np.fromiter(map(HASHES.__getitem__, chain.from_iterable(words)), np.uint64, sum(n)), np.repeat(np.arange(len(n)), n))


def _windows(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the ``depth`` tokens from each position that has so many."""
    n = max(0, len(tokens) - depth + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(depth):
        acc = mix64(acc * np.uint64(31) + tokens[j:j + n])
    return acc.view(np.int64)


def _pack(texts: list[str]) -> tuple[int, bytes]:
    """Texts of blocks (they hold no line break) for a shuffle: length and bytes."""
    raw = "\n".join(texts).encode()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(kinds: bytes, size: int, pack: bytes) -> list[tuple[int, str]]:
    texts = pa.decompress(pack, size, "zstd", asbytes=True).decode().split("\n") if kinds else []
    return list(zip(np.frombuffer(kinds, np.int8).tolist(), texts, strict=True))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, host, page_id, url, html -> the same with the blocks of the page for its html."""
    for batch in batches:
        rows = []
        for page in batch.column(4):
            found = blocks(page.as_py())
            rows.append((np.array([k for k, _ in found], np.int8).tobytes(), *_pack([t for _, t in found])))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary())))],
            ["key", "host", "page_id", "url", "kinds", "size", "pack"])


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` or more tokens (prefix
    doubling; ranks of the full suffix array would split them further)."""
    rank = np.unique(text, return_inverse=True)[1]
    have = 1
    while have < depth:
        step = min(have, depth - have)
        nxt = np.zeros(len(rank), np.int64)
        nxt[:len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1]
        have += step
    return rank


def repeated(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the concatenated streams: whether the ``depth`` tokens from each
    position also stand in another (distinct) stream; each position's rank, -1
    where fewer tokens are left; the stream of each position."""
    owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    ends = np.cumsum([len(s) for s in streams])
    rank = suffix_ranks(np.concatenate(streams), depth)
    rank[np.arange(len(rank)) + depth > ends[owner]] = -1
    lo = np.full(len(rank) + 1, len(streams))
    hi = np.full(len(rank) + 1, -1)
    np.minimum.at(lo, rank, owner)
    np.maximum.at(hi, rank, owner)
    return (lo[rank] != hi[rank]) & (rank >= 0), rank, owner


def _spread(starts: np.ndarray, depth: int) -> np.ndarray:
    """Positions covered by spans of ``depth`` that begin at the marked ones."""
    edge = np.zeros(len(starts) + depth + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + depth, -1)
    return np.cumsum(edge)[:len(starts)] > 0


def _left(found: list[tuple[int, str]], starts: np.ndarray, block: np.ndarray, depth: int, share: float) -> list[bool]:
    """The blocks with a unique run, and those in article markup."""
    covered = np.bincount(block[_spread(starts, depth)], minlength=len(found))
    total = np.bincount(block, minlength=len(found))
    return [k > PLAIN or k == PLAIN and covered[i] <= share * total[i] for i, (k, _) in enumerate(found)]


def _shard(depth: int, share: float):
    """The pages of a shard -> their masks (repeated in the shard), and their texts,
    checked by the markup; a page without enough markup whose host has other shards
    keeps its blocks instead."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        pages = [_unpack(*p) for p in zip(*(group.column(c).to_pylist() for c in ("kinds", "size", "pack")), strict=True)]
        parts = [_tokens([t for _, t in found]) for found in pages]
        raw = [tokens.tobytes() for tokens, _ in parts]
        distinct = sorted({s for s in raw if s})  # equal streams are one page
        streams = [np.frombuffer(s, np.uint64) for s in distinct]
        mark = repeated(streams, depth)[0] if streams else np.zeros(0, np.bool_)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in streams], dtype=np.int64)])
        masks = {s: mark[starts[i]:starts[i + 1]] for i, s in enumerate(distinct)} | {b"": np.zeros(0, np.bool_)}
        several = group.column("shards")[0].as_py() > 1
        open_ = [several and decided(found) is None for found in pages]
        texts = [None if o else checked(found, _left(found, masks[s], block, depth, share))
                 for o, found, s, (_, block) in zip(open_, pages, raw, parts, strict=True)]
        return pa.table({
            **{c: group.column(c) for c in ("key", "host", "page_id", "url")},
            "mask": pa.array([np.packbits(masks[s]).tobytes() for s in raw], pa.binary()), "text": pa.array(texts, pa.string()),
            **{c: pa.array([v if o else None for o, v in zip(open_, group.column(c).to_pylist(), strict=True)], group.column(c).type)
               for c in ("kinds", "size", "pack")}})
    return run


def _open_windows(depth: int):
    """key, host, kinds, size, pack -> key, host, the windows of the page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_windows(_tokens([t for _, t in _unpack(*p)])[0], depth) for p in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, pa.list_(pa.int64()))], ["key", "host", "spans"])
    return run


def _all_windows(depth: int):
    """host, html -> host, a hash of the page's stream, its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [_tokens([t for _, t in blocks(page.as_py())])[0] for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in streams], np.uint64).view(np.int64)),
                 pa.array([_windows(s, depth) for s in streams], pa.list_(pa.int64()))], ["host", "stream", "spans"])
    return run


def _open_texts(depth: int, share: float):
    """page_id, url, mask, kinds, size, pack, more -> page_id, url, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for mask, kinds, size, pack, more in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                found = _unpack(kinds, size, pack)
                _, block = _tokens([t for _, t in found])
                starts = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(block)).astype(np.bool_)
                starts[np.array(more or [], int)] = True
                texts.append(checked(found, _left(found, starts, block, depth, share)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, shard_tokens: int = SHARD_TOKENS,
            covered: float = COVERED) -> DataFrame:
    """``pages(page_id, url, html, ..)`` -> ``page_id, url, text, n_chars``, one
    row per input row.

    A null or empty page has the empty text, as has a page of nothing but
    boilerplate. Null urls share one host. Repeated rows and null page_ids pass
    through; equal streams count as one page when repeats are looked for. Only
    the three columns are read. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    keyed = rows.withColumn("key", F.xxhash64("page_id", "url", "html")).withColumn(
        "host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    # Hosts of more than one shard: at most one row per shard.
    hosts = written(keyed.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / (shard_tokens * CHARS)).alias("shards")).filter("shards > 1"))
    # Dealt by shard: else the join's partitions by host would hold all shards of a hot host.
    sharded = (keyed.select("key", "host", "page_id", "url", "html")
               .mapInArrow(_parsed, "key bigint, host string, page_id bigint, url string, kinds binary, size bigint, pack binary")
               .join(hosts, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
               .withColumn("shard", F.pmod("key", "shards")).repartition("host", "shard"))
    with packed(pages.sparkSession):
        marked = written(sharded.groupBy("host", "shard").applyInArrow(
            _shard(min_tokens, covered),
            "key bigint, host string, page_id bigint, url string, mask binary, text string, kinds binary, size bigint, pack binary"))
    # Where the markup does not decide, and the host has other shards: the windows
    # of such pages among those of all pages (others go by a bitmap, not into a shuffle).
    left = marked.filter("text is null")
    asked = left.select("key", "host", "kinds", "size", "pack").mapInArrow(
        _open_windows(min_tokens), "key bigint, host string, spans array<bigint>").select("key", "host", F.posexplode("spans").alias("at", "span"))
    everywhere = keyed.select("host", "html").mapInArrow(
        _all_windows(min_tokens), "host string, stream bigint, spans array<bigint>").select("host", "stream", F.explode("spans").alias("span"))
    across = (maybe_wanted(everywhere, "span", asked, "span").groupBy("host", "span")
              .agg(F.min("stream").alias("lo"), F.max("stream").alias("hi")).filter("lo <> hi").select("host", "span"))
    more = asked.join(across, ["host", "span"]).groupBy("key").agg(F.collect_set("at").alias("more"))  # within one page
    last = (left.join(more, "key", "left").select("page_id", "url", "mask", "kinds", "size", "pack", "more")
            .mapInArrow(_open_texts(min_tokens, covered), "page_id bigint, url string, text string"))
    return (marked.filter("text is not null").select("page_id", "url", "text").unionByName(last)
            .withColumn("n_chars", F.length("text").cast("bigint")))
