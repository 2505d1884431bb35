"""Merkle manifests against plain folding."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import manifest, shared
from pathloom.llm.queries import queries

from .test_pipeline import COLUMNS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, fan=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(tree, i, fan=2):
    out = []
    for nodes in tree[:-1]:
        first = i // fan * fan
        out.append((i - first, [x for j, x in enumerate(nodes[first : first + fan]) if first + j != i]))
        i //= fan
    return out


def leaf(r, extra=0):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*[text(v) for v in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + extra, r.text)])


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    folded = {}
    for name in names:
        trees[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        folded[name] = levels([leaf(r) for r in trees[name]])
    top = levels([folded[n][-1][0] for n in names])
    out = []
    for j, name in enumerate(names):
        for i, r in enumerate(trees[name]):
            path = siblings(folded[name], i) + siblings(top, j)
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            at = leaf(r, 1) if changed else leaf(r)
            for own, others in path:
                at = h(*others[:own], at, *others[own:])
            out.append((r.doc_id, leaf(r), folded[name][-1][0], top[-1][0], h(*[x for _, o in path for x in o]), at, at == top[-1][0]))
    return Counter(out)


def run(spark, at):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in cols) for r in queries()["op11_merkle_dag_manifest"](spark, at).collect())


def stored(spark, df, folder):
    at = f"file://{folder}"
    df.write.parquet(f"{at}/documents.parquet")
    return at


def test_query(spark, awkward, tmp_path):
    docs = awkward.select(*COLUMNS).withColumn("lang", F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id = 7 THEN 'one' WHEN doc_id % 3 = 0 THEN 'é' ELSE lang END"))
    rows = docs.collect()
    got = run(spark, stored(spark, docs, tmp_path))
    assert got == brute(rows)
    assert any(not k[-1] for k in got) and any(k[-1] for k in got)


def test_one_tree_one_row_and_no_rows(spark, awkward, empty, tmp_path):
    one = awkward.select(*COLUMNS).where("doc_id = 21")
    assert run(spark, stored(spark, one, tmp_path / "a")) == brute(one.collect())
    same = awkward.select(*COLUMNS).where("lang = 'en'")
    assert run(spark, stored(spark, same, tmp_path / "b")) == brute(same.collect())
    assert run(spark, stored(spark, empty.select(*COLUMNS), tmp_path / "c")) == Counter()


@pytest.mark.parametrize(("fan", "span"), [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_segments_of_any_shape(spark, fan, span):
    sizes = {"a": 1, "b": 2, "c": 37, "d": 64, "e": 65}
    rows = [(t, i, n, bytes.fromhex(h(t, str(i)))) for t, n in sizes.items() for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, rank long, size long, digest binary").repartition(3)
    m = manifest.build(spark, leaves, fan, span)
    tops = m.roots.withColumn("path", F.lit(b""))
    got = {(r.tree, r.rank): r for r in manifest.prove(m, leaves.withColumnRenamed("digest", "leaf"), tops).collect()}
    for t, n in sizes.items():
        tree = levels([h(t, str(i)) for i in range(n)], fan)
        for i in range(n):
            r = got[t, i]
            assert r.folded.hex() == tree[-1][0]
            assert [(own, [s.hex() for s in s_]) for own, s_ in manifest.steps_of(bytes(r.proof))] == siblings(tree, i, fan)
    # Proofs of some leaves need their own segments only.
    some = leaves.where("tree = 'c' AND rank IN (0, 36)").withColumnRenamed("digest", "leaf")
    assert {(r.rank, r.folded.hex()) for r in manifest.prove(m, some, tops).collect()} == {(i, levels([h("c", str(j)) for j in range(37)], fan)[-1][0]) for i in (0, 36)}


def test_ranks_of_copies(spark):
    rows = spark.createDataFrame([("x", 1, b"d")] * 50 + [("x", None, b"e"), ("y", 2, b"f")], "tree string, doc_id long, digest binary").repartition(5)
    rows = shared.cut(rows, shared.folder(spark, "test"))
    got = manifest.ranked(rows, ["doc_id", "digest"], shared.folder(spark, "test")).collect()
    assert sorted((r.tree, r["rank"]) for r in got) == [("x", i) for i in range(51)] + [("y", 0)]
    assert {r["rank"] for r in got if r.doc_id is None} == {0} and {r["size"] for r in got if r.tree == "x"} == {51}
