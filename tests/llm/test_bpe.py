import hashlib
import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
from citeloom.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def both():
    return bpe.codec(bpe.default_vocabulary()), tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def same(both, text):
    c, t = both
    want = t.encode(text, add_special_tokens=False).ids
    got = c.encode(text)
    assert got.tolist() == want, text[:80]
    assert c.decode(got) == t.decode(want, skip_special_tokens=False)


def test_matches_library(both):
    for x in ["", " ", "a", "hello world's  best\n\n thing ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "éàü 日本語 🎉🎉", "\x00\x1c\x1d\x1e\x1f\x85᠎​  x", "  \t 　 y", "aaaaaaaaaaaaaaaaaaaaaaa", "1234567890" * 20, "�﻿", "_" * 999, "we'll they've I'D ''s"]:
        same(both, x)
    r = random.Random(1)
    alphabet = "aaabcdeéèn tion ing the 123'\n\t .,$%& ́日🎉"
    for _ in range(3000):
        same(both, "".join(r.choice(alphabet) for _ in range(r.randint(1, 60))))
    for _ in range(300):
        same(both, "".join(chr(r.choice([r.randint(0, 0x7F), r.randint(0x80, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(40)))
    same(both, "ab" * 50_000)
    same(both, "".join(r.choice("etaoinshrdlu") for _ in range(100_000)))


def test_documents(spark, both):
    rows = [(1, None, "x"), (2, "", "y"), (3, "to be or not to be", None), (3, "to be or not to be", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(bpe.encode_documents(df).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in out] == [0, 0, 6, 6]
    assert out[0].decoded_sha256 == hashlib.sha256(b"").hexdigest() == out[1].ids_sha256
    ids = np.array(out[2].token_ids, "<u4")
    assert hashlib.sha256(ids.tobytes()).hexdigest() == out[2].ids_sha256
    assert out[2].decoded_sha256 == hashlib.sha256(b"to be or not to be").hexdigest()
    assert bpe.encode_documents(df.limit(0)).count() == 0
