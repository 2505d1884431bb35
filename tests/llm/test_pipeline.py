"""The pipeline's stages, each against a brute-force version on the same input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from pathloom.llm import shared

from .test_operators import LOWER, WORD, components, path, repeat_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def sized(r, text):
    return (r.doc_id, text, r.lang, r.source, None if text is None else len(text))


def rules(data):
    norm = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    docs = Counter()
    for r in data:
        docs.update({(r.source, norm(x)) for x in (r.text or "").split("\n") if norm(x)})
    often = {k for k, n in docs.items() if n > 10}
    out = []
    for r in data:
        w = WORD.findall(r.text or "")
        gone = [x for x in (r.text or "").split("\n") if (r.source, norm(x)) in often]
        left = len(w) - sum(len(WORD.findall(x)) for x in gone)
        if len(w) >= 10 and 100 * repeat_words(w) <= 20 * len(w) and left >= 0.3 * len(w):
            out.append(sized(r, "\n".join(x for x in r.text.split("\n") if (r.source, norm(x)) not in often)))
    return out


def lines(data):
    norm = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    docs = defaultdict(set)
    own = lambda r: -(1 << 63) if r.doc_id is None else r.doc_id
    for r in data:
        for x in (r.text or "").split("\n"):
            if len(norm(x)) >= 40:
                docs[norm(x)].add(own(r))
    often = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    return [sized(r, None if r.text is None else "\n".join(x for x in r.text.split("\n") if often.get(norm(x), own(r)) == own(r))) for r in data]


def groups(data):
    least, _ = components([(r.doc_id, r.text) for r in data], 5, 80, 100)
    kept = {(r.doc_id, r.text): tuple(r) for r, c in zip(data, least) if c == r.doc_id}
    return list(kept.values())


@pytest.fixture(scope="module")
def stored(spark, awkward, tmp_path_factory):
    """The documents as a folder, and what each stage makes of its input."""
    sf = f"file://{tmp_path_factory.mktemp('sf')}"
    awkward.select(*COLUMNS).write.parquet(f"{sf}/documents.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES:
        made = shared.cut(stage(spark, docs, sf), shared.folder(spark, "test"))
        out[name] = docs, made
        docs = made
    return sf, out


@pytest.mark.parametrize("name,brute", [("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard_join", groups)])
def test_filtering_stages(stored, name, brute):
    docs, made = stored[1][name]
    assert made.columns == COLUMNS
    want = sorted(brute(docs.collect()), key=key)
    assert rows(made) == want and want


def test_rules_judge_large_hosts_by_count(spark):
    word = lambda i, k: f"w{i}x{k}"
    texts = [" ".join(word(i, k) for k in range(20)) + ("\nRead all about it here" if i < 12 else "") for i in range(200)]
    made = P.quality_rules(spark, spark.createDataFrame([(i, t, "en", "big", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.text for r in made.collect()) == sorted(t.split("\n")[0] for t in texts)


def test_copies_with_null_or_repeated_ids(spark):
    say = lambda k: " ".join(f"{k}w{i}" for i in range(120))
    a, b, c, d = say("a"), say("b"), say("c"), say("d")
    data = [(7, a), (7, b), (3, b + " tail"), (4, c), (None, c + " tail"), (None, d), (None, d + " tail"), (None, None), (5, "")]
    made = P.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    got = [tuple(r) for r in made.collect()]
    null_d = [r for r in got if r[0] is None and (r[1] or "").startswith(d)]
    assert len(null_d) == 1 and sorted(set(got) - set(null_d), key=key) == sorted([(7, a), (3, b + " tail"), (4, c), (None, None), (5, "")], key=key)


def test_mix_stage(stored):
    docs, made = stored[1]["source_mix"]
    had, got = Counter(map(tuple, docs.collect())), Counter(map(tuple, made.collect()))
    assert set(got) <= set(had) and all(n <= 2 * had[r] for r, n in got.items()) and made.columns == COLUMNS
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total, taken = sum(size(r) * n for r, n in had.items()), sum(size(r) * n for r, n in got.items())
    assert abs(taken - 1.5 * total) <= max(map(size, had)) * len({r[3] for r in had}) / 2


def test_packing_stage(stored):
    from tokenizers import Tokenizer

    docs, made = stored[1]["best_fit_packing"]
    tok, want = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = made.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_run_is_the_stages(spark, stored):
    sf, out = stored
    got = P.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = out["best_fit_packing"][1].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_empty_documents(spark, empty, tmp_path):
    docs = empty.select(*COLUMNS)
    for _, stage in P.STAGES:
        docs = shared.cut(stage(spark, docs, ""), shared.folder(spark, "test"))
        assert docs.count() == 0
