import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from seqcomplexity.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.tokenizer_path())
ALPHABET = "ab  é'sllre1234.,!?\n\t" + "中文́\U0001f600\x85\x1c՘١ �<|endoftext|>"


def texts(seed, n=300):
    rng = random.Random(seed)
    out = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\n\n  x", "don't I'll we've"]
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 12))) for _ in range(80)) for _ in range(20)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_library(seed):
    codec = bpe.codec(bpe.tokenizer_path())
    for t in texts(seed):
        ids = b"".join(codec.encode(t))
        expected = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, t
        assert codec.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(expected, skip_special_tokens=False) == t


def test_forest_equals_single_tree():
    codec = bpe.codec(bpe.tokenizer_path())
    rng = random.Random(3)
    words = [bytes(rng.choices(b"theandingeru", k=rng.randint(1, 65))) for _ in range(500)]
    for width in (2, 4, 8, 16, 32, 64):
        own = [w for w in words if len(w) <= width + 1]
        assert codec._forest(own, width) == [codec._one_tree(w) for w in own]


def test_long_words_and_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "_PIECE_CHARS", 100)
    codec = bpe.SegmentTreeBPE(bpe.tokenizer_path())
    rng = random.Random(4)
    for t in ("x" * 5000, "".join(rng.choices("abc", k=3000)), " " * 500, " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(400)), "中文 " * 300):
        codec.warm([t])
        assert np.frombuffer(b"".join(codec.encode(t)), "<u4").tolist() == LIBRARY.encode(t).ids


def test_dataframe(spark):
    rows = [(1, "Hello <|endoftext|> é"), (2, None), (3, ""), (4, "same"), (4, "same"), (None, "no id"), (5, "long text. " * 100_000)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_tokens="clash", ids=0) for i, t in rows], "doc_id long, text string, n_tokens string, ids int")
    out = bpe.encode_documents(docs).collect()
    assert len(out) == len(rows)
    expected = {}
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected[r.doc_id] for r in out)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_open_characters():
    text = "a中\U0001f600é"
    raw = text.encode()
    for i in range(len(raw) + 1):
        cut = bpe._whole(raw[:i])
        assert raw[:cut].decode() == raw[:i].decode("utf-8", "ignore")
