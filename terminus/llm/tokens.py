"""Exact pre-tokens of the public tokenizers, and per-worker lookups on them.

The library builds a full alignment for every text, which costs far more than
the ids. A byte-pair model works on one pre-token at a time, so a text's ids
are the concatenation of its pre-tokens' ids, and each distinct pre-token needs
the model once. Special strings are cut out first, as the library does by
default. Texts with a character outside SAFE are split (and lower-cased) by the
library itself, because its Unicode tables and Python's differ there.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import regex

# Split patterns of the two tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Blocks in which Python, regex and the library agree on every code point.
SAFE = r"\x00-ԯḀ-⁯₠-⯿　-ヿ一-鿿가-힣＀-￯"
LONGEST_CACHED = 64  # characters; longer pre-tokens are encoded each time


def byte_characters() -> dict[int, str]:
    """The characters that byte-level models write for bytes: a printable byte is
    itself, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_CHARACTERS = byte_characters()


@functools.cache
def safe_pattern(pattern: str):
    """``pattern`` for SAFE texts in the standard library's faster engine, its
    properties written out as the ranges that they have there."""
    bounds = [ord(c) for c in re.sub(r"\\x00", "\0", SAFE) if c != "-"]
    safe = "".join(chr(c) for a, b in zip(bounds[::2], bounds[1::2], strict=True) for c in range(a, b + 1))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs: list[list[int]] = []
        for c in map(ord, regex.findall(name, safe)):
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        ranges = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
        pattern = re.sub(rf"(?<!\[)(?<!\}})(?<!\^){re.escape(name)}(?=[+(|)]|$)", lambda _: f"[{ranges}]", pattern)  # noqa: B023
        pattern = pattern.replace(name, ranges)
    # The last name was white space: its complement is a class of its own.
    pattern = pattern.replace(r"\S", f"[^{ranges}]")
    return re.compile(pattern)


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare file name from the installed package."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Pretokens:
    """Pre-tokens and their ids for one tokenizer file (made once per worker)."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer
        path = tokenizer_file(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        del spec  # before the library reads the file for itself
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.findall = safe_pattern(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        self.unsafe = re.compile(f"[^{SAFE}]" + ("|Σ" if self.lower else "")).search

    def split(self, part: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if part.isascii():
            return self.findall(part.lower() if self.lower else part)
        if self.unsafe(part):
            if self.lower:
                part = self.tok.normalizer.normalize_str(part)
            return [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        if self.lower:
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = part.lower()
        return self.findall(part)

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """(ordinary text, None) and (special string, its id) in order."""
        if not any(s in text for s in self.special):
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self.cut.split(text) if p]

    def encode(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(BYTE_CHARACTERS))]


class Lookup(dict):
    """Two tiers: fixed entries given at the start, then a bounded cache.

    When the cache is full it becomes the old generation, and what is asked for
    again moves over from there. Values are a pure function of the key, so
    forgetting one costs time only.
    """

    def __init__(self, fn, fixed: dict | None = None, bound: int = 250_000):
        super().__init__(fixed or {})
        self.fixed, self.fn, self.bound = fixed or {}, fn, bound + len(fixed or {})
        self.old: dict = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
                self.update(self.fixed)
            self[key] = value
        return value
