"""Token counts against the libraries on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pathloom.llm import tokencount
from pathloom.llm.queries import queries

from .test_operators import path
from .test_pipeline import COLUMNS

MODEL = path("piece_bpe_32k.model")
#: What cuts could get wrong: runs of spaces, the mark, lines, pieces that span other white space, special strings, bytes without a piece.
PARTS = [" ", "  ", "\n", "▁", "a", "the", "ing", "é", "\r", ";\r", "\t", "　", "\x00", "😀", "<s>", "</s>", "<0x0A>", ".", "{", "\xa0", "23", "return "]


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "\n\n", " \n ", "a "] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 20, 64, 16])
def test_cuts_and_windows(most):
    sp, own, every = sentencepiece.SentencePieceProcessor(model_file=MODEL), tokencount.Lengths(MODEL), texts(1500, 90)
    out = np.zeros(len(every), np.int64)
    for a, b, found, ptr in tokencount.windows(pa.array(every, pa.string()), tokencount.breaks_of(MODEL), most):
        coded = found.dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(own.of(coded.dictionary)[coded.indices.to_numpy()])]) if len(found) else np.zeros(1, np.int64)
        out[a:b] += ends[ptr[1:]] - ends[ptr[:-1]]
    assert out.tolist() == [len(sp.encode(t or "")) for t in every]


def test_cache_forgets(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHED", 8)
    own = tokencount.Lengths(MODEL, (pa.array([b" the"], pa.binary()), np.array([1], np.uint16)))
    words = pa.array([f" w{i}".encode() for i in range(40)] + [b" the", b" ", b"\n"], pa.binary())
    want = own.encoded(words.to_pylist())
    for _ in range(3):
        assert own.of(words).tolist() == want
        assert len(own.young) <= 4 and len(own.old) <= 4
    assert b" the" not in own.young | own.old  # the table answers


def test_query(spark, awkward, empty, tmp_path):
    sp, at = sentencepiece.SentencePieceProcessor(model_file=MODEL), f"file://{tmp_path}/a"
    awkward.select(*COLUMNS).write.parquet(f"{at}/documents.parquet")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in awkward.collect())
    got = queries()["op12_two_tier_token_counts"](spark, at).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want and any(x[3] for x in want)
    at = f"file://{tmp_path}/b"
    empty.select(*COLUMNS).write.parquet(f"{at}/documents.parquet")
    assert queries()["op12_two_tier_token_counts"](spark, at).collect() == []


def test_frequent_words_come_from_all_documents(spark):
    df = spark.createDataFrame([(f"all all w{i} and " + "x" * 40 + " v" * (i % 3),) for i in range(90)], "text string").repartition(7)
    assert sorted(tokencount.frequent(df, (0x20, 0x0A), most=3, merged_rows=2)) == [b" all", b" and", b" v"]


def test_nothing_is_shuffled_by_word(spark, awkward):
    plan = tokencount.count_tokens(awkward, MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.replace("ReusedExchange", "").split("InMemoryTableScan")[0]


def test_other_tokenizers(spark, awkward, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect())
    got = tokencount.count_tokens(awkward, path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    # A model that allows no cuts is asked for whole texts.
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(tokencount, "breaks_of", lambda p: ())
    got = tokencount.count_tokens(awkward.where(F.length("text") < 3000), MODEL).collect()
    assert all(r.n_tokens > 0 or not r.n_bytes for r in got)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r.doc_id), len(sp.encode(r.text))) for r in awkward.collect() if r.text is not None and len(r.text) < 3000)
