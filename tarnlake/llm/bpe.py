"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding through an offset table.

Two facts make the encoder exact. A token sequence is the BPE encoding of its bytes if and only if each
two neighbours stay apart when their joined bytes are encoded. And the first token of that encoding is
among the vocabulary tokens that are prefixes of the rest. So the encoder takes the longest token at
each position, checks it against its left neighbour in a pair-compatibility table, falls back to the
next shorter prefix token, and steps back where none fits; a position once given up is marked, so each
is left at most once and the work is linear.

Whether two tokens stay apart is found from their merge trees: as merges run in rank order, a token's
right edge passes through the nodes of its right spine and its neighbour's left edge through those of
its left spine. The pair is incompatible exactly if some merge joins two such nodes while both exist.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tarnlake.llm.scratch import bound_batches
from tarnlake.llm.tokens import ChunkCache, byte_alphabet, little, split_before_words

_NEVER = 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class BacktrackingBPE:
    """Reads a tokenizers-library file of the byte-level kind without normalizer or prefix space."""

    def __init__(self, path: str, cap: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        import public_tokenizers

        self._pieces = regex.compile(public_tokenizers.PATTERN)

        size = max([*vocab.values(), *self.added.values()]) + 1
        text = [b""] * size
        for t, i in vocab.items():
            text[i] = as_bytes(t)
        for t, i in self.added.items():
            text[i] = t.encode()
        # offset table for decoding
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self._bytes = np.frombuffer(b"".join(text), dtype=np.uint8)

        self._rank: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._rank[left, right] = k
            self._halves.setdefault(whole, (left, right, k))
        self._right: dict[int, list[tuple[int, int, int]]] = {}
        self._left: dict[int, list[tuple[int, int, int]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}

        # only tokens that their own bytes encode to can occur; parents precede in rank order
        sound = {i for i in vocab.values() if len(text[i]) == 1}
        for whole, (left, right, k) in sorted(self._halves.items(), key=lambda x: x[1][2]):
            if left in sound and right in sound and self._first_join(left, right) == k:
                sound.add(whole)
        self._whole = {text[i].decode("latin-1"): i for i in sound}
        self._length = [len(t) for t in text]
        self._shorter: dict[int, int | None] = {}
        self._match = ahocorasick.Automaton()
        for t, i in self._whole.items():
            self._match.add_word(t, i)
            self._shorter[i] = next((self._whole[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self._whole), None)
        self._match.make_automaton()
        self._cache = ChunkCache(lambda chunk: little(self._encode_run(" " + chunk)), cap)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(node, rank at which it forms, rank at which it is used up), from the token inwards."""
        known = (self._left, self._right)[side]
        if token not in known:
            out, node, until = [], token, _NEVER
            while node in self._halves:
                half = self._halves[node]
                out.append((node, half[2], until))
                node, until = half[side], half[2]
            known[token] = [*out, (node, -1, until)]
        return known[token]

    def _first_join(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of a and b, or _NEVER."""
        best = _NEVER
        for x, born_x, gone_x in self._spine(a, 1):
            for y, born_y, gone_y in self._spine(b, 0):
                k = self._rank.get((x, y), _NEVER)
                # of equal merges the left one runs first: x must outlive the rank, y only reach it
                if k < best and born_x < k < gone_x and born_y < k <= gone_y:
                    best = k
        return best

    def compatible(self, a: int, b: int) -> bool:
        found = self._apart.get((a, b))
        if found is None:
            found = self._first_join(a, b) == _NEVER
            if len(self._apart) < 1_000_000:
                self._apart[a, b] = found
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """piece: one pre-token, its UTF-8 bytes read as Latin-1."""
        token = self._whole.get(piece)
        if token is not None:
            return [token]
        n = len(piece)
        longest = [0] * n
        length = self._length
        for end, token in self._match.iter(piece):
            longest[end - length[token] + 1] = token  # matches come by end, so the last one is the longest
        out: list[int] = []
        given_up = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not given_up[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else token
                continue
            shorter = self._shorter[token]
            while shorter is None:
                given_up[at] = 1
                token = out.pop()
                at -= length[token]
                shorter = self._shorter[token]
            token = shorter
        return out

    def _encode_run(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self._pieces.findall(text):
            out += self.encode_piece(piece.encode().decode("latin-1"))
        return out

    def encode(self, text: str) -> bytes:
        """ids as little-endian uint32; added tokens in the text are found first, as the library does."""
        if self._split_added and "<|" in text:
            out = b""
            for part in self._split_added.split(text):
                out += little([self.added[part]]) if part in self.added else self._encode_plain(part)
            return out
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        head, rest = split_before_words(text)
        return little(self._encode_run(head)) + b"".join(map(self._cache.__getitem__, rest))

    def decode_bytes(self, ids: bytes) -> bytes:
        """Every token's bytes are a slice of one table; all slices are gathered at once."""
        k = np.frombuffer(ids, dtype="<u4")
        start, size = self._offsets[k], self._offsets[k + 1] - self._offsets[k]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self._bytes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODERS: dict[str, BacktrackingBPE] = {}


def coder(path: str) -> BacktrackingBPE:
    if path not in _CODERS:
        _CODERS[path] = BacktrackingBPE(path)
    return _CODERS[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (little-endian uint32) and of the decoded text.

    Row by row, without a shuffle; null and empty texts give no ids, texts of any length are coded whole. Repeated rows
    repeat, null ids stay null, an empty table gives no rows; other columns take no part.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(code, SCHEMA)
