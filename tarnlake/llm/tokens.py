"""Encoding of whole texts, with the ids that the tokenizers library gives.

The library itself reads 2 to 3 MB/s of new words on a core, so texts go through tiktoken's merge loop over
the same vocabulary, which gives the same ids (tests/llm/test_tokens.py compares both on whole texts and
on all of Unicode). Texts that hold a special token's opening go through the library. For word files,
whose words end in a mark that tiktoken lacks, distinct chunks between white space are encoded once for each
worker: those of plain Latin characters by tiktoken, all others by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cached_property

import numpy as np

from tarnlake.llm.workers import kept

_SPACE_THEN_SPACE = re.compile(r" (?=\s|\Z)")
_SAFE_SPACE = re.compile(r" (?=\S)")
_PLAIN_SPACES = re.compile(r"[ \t\n\r]+")
_LATIN = re.compile(r"[!-~\u00a1-\u012f\u0131-\u0148\u014a-\u017e]*")  # no marks to compose, no special cases in lower()
MARK = "\ue000"  # ends a word inside the word encoder; three bytes in UTF-8


def split_before_words(text: str) -> tuple[str, list[str]]:
    """(head, rest): the text is head plus, for each of rest, one space and it.

    Every cut is at a space before a non-space, where the byte-level pattern always begins a piece.
    """
    parts = _SAFE_SPACE.split(text) if _SPACE_THEN_SPACE.search(text) else text.split(" ")
    return parts[0], parts[1:]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def little(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class ChunkCache(dict):
    """chunk -> its ids' bytes. Keeps ``cap`` chunks of at most 64 characters, so memory is bounded."""

    def __init__(self, encode: Callable[[str], bytes], cap: int):
        super().__init__()
        self._encode, self._cap = encode, cap

    def __missing__(self, chunk: str) -> bytes:
        ids = self._encode(chunk)
        if len(self) < self._cap and len(chunk) <= 64:
            self[chunk] = ids
        return ids


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class ByteEncoder:
    """For byte_bpe files: encode(text) gives the text's ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items()}
        order = {bytes(to_byte[c] for c in a + b): 256 + k for k, (a, b) in enumerate(model["merges"])}
        singles = {t: k for k, t in enumerate(sorted(t for t in ranks if len(t) == 1))}
        merge_rank = singles | order
        self._to_id = np.zeros(max(merge_rank.values()) + 1, dtype="<u4")
        for token, rank in merge_rank.items():
            self._to_id[rank] = ranks[token]
        self._fast = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_rank, special_tokens={})
        self._path = path

    @cached_property
    def _tok(self):
        """The library's own tokenizer, loaded by the first text that needs it."""
        return _library(self._path)

    def whole(self, text: str) -> bytes:
        return little(self._tok.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return self.whole(text) if "<|" in text else self._to_id[self._fast.encode_to_numpy(text)].tobytes()


class WordEncoder:
    """For word_bpe files (lower case, words end in a mark, white space dropped)."""

    def __init__(self, path: str, cap: int = 400_000):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        suffix, mark = model["end_of_word_suffix"], MARK.encode()

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(to_byte[c] for c in (token[: -len(suffix)] if ends else token)) + mark * ends

        # the mark first joins itself, then the byte before it; after that the file's merges follow in order
        joined = [bytes([b]) for b in range(256)] + [mark[:2], mark] + [bytes([b]) + mark for b in range(256)]
        joined += [raw(a + b) for a, b in model["merges"]]
        rank: dict[bytes, int] = {}
        for k, t in enumerate(joined):
            rank.setdefault(t, k)  # the file may merge the mark's own bytes too, which Latin chunks don't hold
        self._id_bytes = [b""] * len(joined)
        for token, i in model["vocab"].items():
            self._id_bytes[rank[raw(token)]] = little([i])
        self._fast = tiktoken.Encoding("word", pat_str=rf"[^{MARK}]*{MARK}", mergeable_ranks=rank, special_tokens={})
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # the file's own pattern
        self._path = path
        self._cache = ChunkCache(self._chunk, cap)

    @cached_property
    def _tok(self):
        return _library(self._path)

    def whole(self, text: str) -> bytes:
        return little(self._tok.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not _LATIN.fullmatch(chunk):
            return self.whole(chunk)
        low = chunk.lower()
        if low.isalpha():  # the two commonest shapes need no pattern: a word, and one with a sign behind it
            marked = low + MARK
        elif low[:-1].isalpha():
            marked = low[:-1] + MARK + low[-1] + MARK
        else:
            marked = MARK.join(self._pieces.findall(low)) + MARK
        return b"".join(map(self._id_bytes.__getitem__, self._fast.encode_ordinary(marked)))

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self.whole(text)
        return b"".join(map(self._cache.__getitem__, _PLAIN_SPACES.split(text)))


_ENCODERS: dict[tuple, ByteEncoder | WordEncoder] = kept()


def encoder(kind: type, path: str) -> ByteEncoder | WordEncoder:
    """One for each worker process; Spark reuses workers, so caches outlive tasks, until another operator's task comes."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]
