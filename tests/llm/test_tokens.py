import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tarnlake.llm import bpe
from tarnlake.llm.tokens import ByteEncoder, WordEncoder, little

BYTE, WORD = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
ALPHABET = "ab Z'sté\n\t   \x1c.,!9<|éÀΣςİßŉÞ日本🙂"


def random_texts(n, words, seed=3):
    rnd = random.Random(seed)
    for k in range(n):
        if k % 3:
            t = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40)))
        else:
            t = "".join(rnd.choice(words) for _ in range(rnd.randint(1, 5)))
        yield t + "<|endoftext|>" + t[:2] if k % 11 == 0 else t
    yield from ["", "a" * 3000, "ab" * 999, " " * 500 + "x", "\n" * 99, "=-" * 300, "  x ", " \n y"]


@pytest.mark.parametrize(("kind", "file"), [(ByteEncoder, BYTE), (WordEncoder, WORD)])
def test_cached_encoders_equal_the_library(kind, file):
    tok, e = Tokenizer.from_file(file), kind(file)
    words = [w.replace("</w>", "") for w in tok.get_vocab() if w.isascii()]
    for t in random_texts(4000, words):
        assert e.encode(t) == little(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_byte_encoder_equals_the_library_on_all_of_unicode():
    tok, e = Tokenizer.from_file(BYTE), ByteEncoder(BYTE)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x32000 or c % 97 == 0)]
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}x{chr(c)}{chr(c)}!" for c in points]
    for k in range(0, len(texts), 5000):
        some = texts[k : k + 5000]
        for t, want in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert e.encode(t) == little(want.ids), repr(t)


def test_backtracking_equals_the_library():
    tok, c = Tokenizer.from_file(BYTE), bpe.coder(BYTE)
    words = [w.encode("latin-1").decode("utf8", "replace") for w in c._whole]
    for t in random_texts(4000, words):
        ids = c.encode(t)
        assert ids == little(tok.encode(t, add_special_tokens=False).ids), repr(t)
        assert c.decode(ids) == tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_encode_decode_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x"), (-3, "x")], "doc_id long, text string")
    tok = Tokenizer.from_file(BYTE)
    both = docs.unionByName(odd)
    want = []
    for r in both.collect():
        ids = little(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(both, BYTE).collect())) == sorted(want)
    assert bpe.encode_decode(both.limit(0), BYTE).count() == 0
