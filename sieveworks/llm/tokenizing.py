"""Tokenizer files inside tasks: loading, splitting into pre-tokens, counting and encoding with bounded caches."""

from __future__ import annotations

import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters and numbers of the characters that :data:`PLAIN` admits; all were assigned long ago, so
#: every Unicode version classes them alike.
_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘-„…€]*\Z")
#: The byte-level pre-token pattern, for plain characters.
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
#: The pre-token pattern of the lower-casing tokenizer, for plain characters.
LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
CACHE_ENTRIES = 500_000
CACHED_CHARS = 64


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def pre_tokens(path: str, text: str) -> list[str]:
    """Pre-tokens of a byte-level tokenizer without a normalizer, added tokens kept whole.

    Plain characters take the pattern above; any other text takes the library's own splitter.
    """
    special = special_tokens(path)
    if any(s in text for s in special):
        parts = re.split("(" + "|".join(map(re.escape, special)) + ")", text)
        return [t for i, part in enumerate(parts) if part for t in ([part] if i % 2 else pre_tokens(path, part))]
    if PLAIN.match(text):
        return BYTE_LEVEL.findall(text)
    return [text[a:b] for _, (a, b) in _byte_spans(path, text)]


def _byte_spans(path: str, text: str):
    return tokenizer(path).pre_tokenizer.pre_tokenize_str(text)


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the rest take the code points from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


def _byte_level(piece: str) -> str:
    return piece.encode("utf-8", "replace").decode("latin-1").translate(_ALPHABET)


def count_pieces(path: str, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token; an added token is one."""
    special, model = special_tokens(path), tokenizer(path).model
    return [1 if p in special else len(model.tokenize(_byte_level(p))) for p in pieces]


class RunEncoder:
    """Ids of whole texts for a lower-casing tokenizer that drops white space.

    Such a tokenizer treats every run between white space alone, and every pre-token of a run
    alone, so ids are kept for both; both caches are bounded, and long runs are not kept.  Runs of other than plain characters are left to the library.
    """

    def __init__(self, path: str):
        import numpy as np

        self.tokenizer, self.special, self.np = tokenizer(path), special_tokens(path), np
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.misses = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        runs, known = _SPACE.split(text), self.runs
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            return b"".join([known[r] if r in known else self._new(r) for r in runs])

    def _new(self, run: str) -> bytes:
        if PLAIN.match(run) and not any(s in run for s in self.special):
            ids = b"".join([self.parts[p] if p in self.parts else self._part(p) for p in LOWER_WORDS.findall(run.lower())])
        else:
            ids = self.np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        self._keep(self.runs, run, ids)
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.np.array([t.id for t in self.model.tokenize(_byte_level(part))], "<u4").tobytes()
        self._keep(self.parts, part, ids)
        return ids

    def _keep(self, cache: dict[str, bytes], key: str, ids: bytes) -> None:
        """Frequent keys come early and stay; a full cache starts anew after many misses."""
        if len(key) > CACHED_CHARS:
            return
        if len(cache) < CACHE_ENTRIES:
            cache[key] = ids
            return
        self.misses += 1
        if self.misses > 8 * CACHE_ENTRIES:
            self.misses = 0
            cache.clear()


@lru_cache(maxsize=2)
def run_encoder(path: str) -> RunEncoder:
    """One encoder for each worker process, kept from task to task."""
    return RunEncoder(path)


_SPACE = re.compile("[ \t\n\r]+")
