from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from statuta.llm import tokenbin as tb

ODD = ["", " ", "a", "Hello, WORLD's  end...", "x y　z", "tab\tand\nline\r\n", "İstanbul ΑΣ ΑΣ. ß ﬁ", "áé ́x", "<|endoftext|> in<|startoftext|>side", "中文 字", "1234 56.78", "\x1c\x1d", "don't we'll I'M", "a\x0bb\x0cc\x1cd\x85e\x00f", "H̱H Ḱ 's's!'s",  "emoji 👩‍👩‍👧 x", "a" * 3000, "é" * 500 + " b"]


def direct(texts):
    t = Tokenizer.from_file(tb.tokenizer_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcÀé .,'’\n 123-Σσİ") for _ in range(rng.randrange(60))) for _ in range(400)]
    ids, counts = tb.Encoder(tb.tokenizer_path()).encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, got, want in zip(texts, parts, direct(texts), strict=True):
        assert got.tolist() == want, text


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, "Hello again", "s"), (None, "no id", "s"), (7, None, "s"), (3, "Hello again", "s")]
    folder = f"{tmp_path_factory.mktemp('t')}/set"
    tb.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), folder)
    return rows, folder


def test_round_trip(spark, files):
    rows, folder = files
    got = sorted(tb.read_token_files(spark, folder, ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == tb.END_ID
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted(x + [1] for x in direct([r[1] or "" for r in rows]))
    assert sorted(r.ids for r in got) == want


def test_the_dictionary_is_the_same_whatever_the_partitions(spark, tmp_path):
    rows = [(i, f"common words {i % 7} and some more of them {i}" * 3) for i in range(300)]
    made = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        made.append(tb.train_dictionary(docs, tb.tokenizer_path()))
    assert made[0] == made[1] and made[0][1] == "trained"
    few = spark.createDataFrame([(1, "one text"), (2, "")], "doc_id long, text string")
    assert tb.train_dictionary(few, tb.tokenizer_path())[1] == "samples"
    tb.write_token_files(few, f"{tmp_path}/few")
    assert sorted(r.ids for r in tb.read_token_files(spark, f"{tmp_path}/few", ids=True).collect()) == sorted(x + [1] for x in direct(["one text", ""]))


def test_one_document(spark, files):
    rows, folder = files
    want = [x + [1] for x in direct([r[1] for r in rows if r[0] == 3])]
    assert sorted(tb.read_document(spark, folder, 3)) == sorted(want)
    assert tb.read_document(spark, folder, 99) == []


def test_no_rows(spark, tmp_path):
    tb.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/set")
    assert tb.read_token_files(spark, f"{tmp_path}/set").count() == 0
    assert spark.read.parquet(f"{tmp_path}/set/dictionary").first()["kind"] == "none"
