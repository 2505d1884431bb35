"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import exchange, shared, treap
from pathloom.llm.queries import queries

from .test_pipeline import COLUMNS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """docs, items: (id, text).  Rows (item, rank, doc, score)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query(spark, awkward, empty, tmp_path):
    at = f"file://{tmp_path}/a"
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    long = max((t or "" for _, t in docs), key=len)
    items = [(1, docs[20][1]), (2, None), (3, "..."), (4, "ONE two two zzz"), (5, long), (5, long[:200]), (None, "words xxxx é É")]
    awkward.select(*COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"{at}/benchmark.parquet")
    got = rows(queries()["op13_k2_treap_search"](spark, at))
    assert got == brute(docs, items) and {x[0] for x in got} >= {1, 4, 5}
    for name, docs_, items_ in (("b", empty.select("doc_id", "text"), items), ("c", awkward.select("doc_id", "text"), [])):
        at = f"file://{tmp_path}/{name}"
        docs_.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(items_, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        assert rows(queries()["op13_k2_treap_search"](spark, at)) == []


def test_many_shards_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(treap, "BLOCK", 3)
    monkeypatch.setattr(treap, "SHARDS_PER_TASK", 2)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    say = lambda n: " ".join(rng.choice(words[: rng.choice((5, 120))]) for _ in range(n))
    docs = [(i, say(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)] + [(None, docs[7][1])] * 3 + [(7, docs[7][1])]
    items = [(i, say(rng.randint(1, 40))) for i in range(11)] + [(50, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    shards, n = treap.build(df, shard_bytes=3000)
    assert shards.count() > 6
    for k in (1, 20, 95):
        assert rows(treap.search(shards, n, spark.createDataFrame(items, "item_id long, text string"), k)) == brute(docs, items, k)


@pytest.mark.parametrize("seed", range(4))
def test_descent(spark, seed):
    """One shard: bounds hold in every node, and the k best come out whatever the batch."""
    rng = np.random.default_rng(seed)
    docs, n_terms = 300, 50
    key = np.unique(rng.integers(0, docs * n_terms, 2500))
    row, h, tf = key // n_terms, (key % n_terms).astype(np.uint64) * np.uint64(977), np.where(rng.random(len(key)) < 0.01, 400, rng.integers(1, 6, len(key)))
    made = treap.grid(row, h, tf, docs, docs, int(tf.sum()))
    order = made.pop("order")
    at = f"{shared.folder(spark, 'test')}/treap"
    exchange.put_arrays(at, **made, ids=order, known=np.ones(len(order), bool))
    t = treap.Treap(at)
    dense = np.zeros((n_terms, len(order)), np.int64)
    place = {int(x): i for i, x in enumerate(order)}
    for r, x, f in zip(row, h, tf):
        dense[int(x) // 977, place[int(r)]] = treap.impact(np.array([f]), t.m[place[int(r)]])[0]
    asked = rng.choice(n_terms, 7, replace=False)
    weights = rng.integers(1, 9, 7)
    scores = (dense[asked] * weights[:, None]).sum(0)
    cols, got = t.best(asked.astype(np.uint64) * np.uint64(977), weights, 20, 1)
    assert (scores[cols] == got).all() and len(set(cols.tolist())) == len(cols)
    floor = np.sort(scores)[-20]
    assert set(np.flatnonzero(scores >= max(1, floor)).tolist()) <= set(cols.tolist())
    assert t.best(asked.astype(np.uint64) * np.uint64(977), weights, 20, int(scores.max()) + 1)[0].size == 0


def test_long_texts_are_windowed():
    text = "Ab1 ab1, é-É x" * 40
    row, h, n = treap.term_counts(pa.array(["zz", text, None]), 16)
    whole = treap.term_counts(pa.array(["zz", text, None]))
    total = Counter()
    for r, x, c in zip(row.tolist(), h.tolist(), n.tolist()):
        total[r, x] += c
    assert total == Counter({(r, x): c for r, x, c in zip(*(a.tolist() for a in whole))}) and len(row) > len(whole[0])
    made = treap.grid(row, h, n, 3, 2, 10)
    assert len(made["tf"]) == len(whole[0])
