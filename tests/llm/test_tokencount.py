import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

import public_tokenizers
from seqcomplexity.llm import tokencount


def plain(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("width,block", [(2, 2), (2, 6), (2, 1 << 20), (4, 4), (4, 32)])
def test_scan(spark, tmp_path, width, block):
    rng = np.random.default_rng(width * block)
    files = {"empty": [], "none": [5] * 9, "only": [7], "twice": [7, 7], "open": [1, 7, 2], "odd": [0x0700, 7, 0x0007, 0x0707] * 3}
    files |= {f"r{i}": rng.choice([1, 2, 7], 40, p=[0.6, 0.2, 0.2]).tolist() for i in range(4)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes() + (b"\x07" if name == "odd" else b""))
    named = spark.createDataFrame([Row(file=f"file://{tmp_path}/{n}") for n in [*files, "open"]])
    found = {}
    for r in tokencount.scan_token_files(spark, named, 7, width, block).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.ordinal, r.start, r.n_tokens, r.closed))
    for name, ids in files.items():
        assert sorted(found.get(name, [])) == plain(ids, 7), name


def test_counts_of_documents(spark):
    texts = ["", None, "a", "Hello  world\n", "<|endoftext|> é 中", "same", "same", "long words " * 120_000, "x" * 50_000, " " * 3000]
    docs = spark.createDataFrame([Row(doc_id=i if i != 6 else 5, text=t, file="clash", ordinal=1) for i, t in enumerate(texts)], "doc_id long, text string, file string, ordinal int")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    expected = sorted((i if i != 6 else 5, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_tokens) for r in tokencount.count_tokens(docs, 64).collect()) == expected
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_bad_widths(spark):
    with pytest.raises(ValueError):
        tokencount.scan_token_files(spark, spark.createDataFrame([], "file string"), width=3)
