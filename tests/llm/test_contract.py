"""The registered query functions on a stored folder, every column against a brute-force version."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import exchange, lm, media, packing, shared, tokens
from pathloom.llm.encode import Encoder, mode_of
from pathloom.llm.queries import queries

from .test_operators import kneser_ney, path
from .test_pipeline import COLUMNS, key


@pytest.fixture(scope="module")
def sf(spark, awkward, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    awkward.select(*COLUMNS).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def data(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def run(spark, sf, name):
    return queries()[name](spark, sf).collect()


def slow_hash(image):
    """The cosine hash sample by sample."""
    height, width = image.shape
    cuts = [[(k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32)) for k in range(32)] for n in (height, width)]
    grid = [[float(image[a:b, c:d].mean()) for c, d in cuts[1]] for a, b in cuts[0]]
    cos = lambda u, k: math.cos(math.pi * u * (2 * k + 1) / 64)
    low = [round(sum(grid[y][x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    median = float(np.median(low[1:]))
    bits = "".join("1" if x > median else "0" for x in low)
    return f"{int(bits, 2):016x}"


def test_media_query(spark, sf, data):
    got = {(r.doc_id, r.payload_sha256): r for r in run(spark, sf, "op2_png_media_columns")}
    assert len(got) == len({(r.doc_id, r.text or "") for r in data})
    kinds = Counter()
    for r in data:
        raw = (r.text or "").encode()
        body = raw + bytes(-len(raw) % 64 if raw else 64)
        image = np.frombuffer(body, np.uint8).reshape(-1, 64)
        png = media.encode_png(image)
        kinds.update(media.inflate(png)[:, 0].tolist())
        x = got[r.doc_id, hashlib.sha256(body).hexdigest()]
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32) == (len(raw), len(body), zlib.crc32(body[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert x.feature == media.cosine_hash(image)
    assert set(kinds) == {0, 1, 2, 3, 4}  # every row filter is undone
    assert media.cosine_hash(image) == slow_hash(image)


def test_scores_query(spark, sf, data):
    held = lambda r: zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2
    want = kneser_ney([r.text for r in data if not held(r)], [r.text for r in data], 2)
    want = sorted(((r.doc_id, held(r), *w) for r, w in zip(data, want)), key=lambda x: (*key(x[:4]), x[5]))
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in run(spark, sf, "op3_kneser_ney_scores")), key=lambda x: (*key(x[:4]), x[5]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert any(r[1] for r in want) and not all(r[1] for r in want)


def test_token_query_is_what_lies_in_the_files(spark, sf, data, monkeypatch):
    from tokenizers import Tokenizer

    made = []
    folder = shared.folder
    monkeypatch.setattr(shared, "folder", lambda s, name: made.append(folder(s, name)) or made[-1])
    got = sorted(run(spark, sf, "op4_orc_token_ids"), key=lambda r: r.start)
    rows = spark.read.schema(tokens.SCHEMA).orc(made[-1]).collect()
    rows.sort(key=lambda r: (r.part, r.at))
    every = np.array([i for r in rows for i in r.ids], "<u4")
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(every[at : at + r.n_tokens].tobytes())
        at += r.n_tokens
    assert at == len(every)
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids_of = lambda r: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(ids_of(r)), zlib.crc32(ids_of(r).tobytes())) for r in data)


def test_rows_of_one_id_are_spread(spark, tmp_path):
    df = spark.createDataFrame([(7, f"word{i} " * (1 + i % 9)) for i in range(400)], "doc_id long, text string").repartition(4)
    at = f"file://{tmp_path}/one"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(df, at, path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(spark.read.schema(tokens.SCHEMA).orc(at).collect(), key=lambda r: (r.part, r.at))
    got = sorted(tokens.token_places(spark, at).collect(), key=lambda r: r.start)
    assert len({r.part for r in rows}) > 1
    assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows] == [r.ids_crc32 for r in got]


def test_packing_query(spark, sf, data):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for r in data:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = run(spark, sf, "op10_island_packing")
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_generations_beat_best_fit(seed):
    """Pieces of which three fill a bin: best-fit misses the bound, breeding comes nearer."""
    rng, size = np.random.default_rng(seed), []
    for _ in range(25):
        a = rng.integers(26, 45)
        b = rng.integers(26, min(45, 80 - a) + 1)
        size += [a, b, 100 - a - b]
    size = np.array(size)
    first = len(packing.best_fit(size, 100).left)
    got, bred, _ = packing.evolve(size, 100, [], seed)
    assert packing.lower_bound(size, 100) < first and len(got.left) < first and bred > 0
    assert (np.bincount(got.bin_of, size) == 100 - got.left).all()


def test_hard_pieces_through_spark(spark):
    rng, size = np.random.default_rng(3), []
    for _ in range(30):
        a = rng.integers(26, 45)
        b = rng.integers(26, min(45, 80 - a) + 1)
        size += [a, b, 100 - a - b]
    pieces = spark.createDataFrame([(i, int(z)) for i, z in enumerate(size)], "rid long, length long")
    got = packing.pack(shared.cut(pieces, shared.folder(spark, "test")), 100).collect()
    assert sorted(r.rid for r in got) == list(range(len(size)))
    assert len({r.sequence_id for r in got}) < len(packing.best_fit(np.array(size), 100).left)


def test_tokenizer_files_are_read_for_their_cuts(tmp_path):
    import json

    assert mode_of(path("word_bpe_49k.json")) == "words" and mode_of(path("byte_bpe_50k.json")) == "spaced"
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        own = Encoder(str(other))
        assert own.mode == "whole"
        import pyarrow as pa

        texts = ["a b  c", "", None, " x <|endoftext|> y "]
        ids, ptr = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files_opened_do_not_grow_with_shards(spark, monkeypatch, tmp_path):
    """Twice the documents: twice the shards and flushes, and twice the files opened, not four times."""
    from pathloom.llm import jaccard

    log = tmp_path / "opened"
    view = shared.view

    def counted(uri):
        with open(log, "a") as f:
            f.write("x\n")
        return view(uri)

    monkeypatch.setattr(jaccard, "DOCS_PER_SHARD", 4)
    monkeypatch.setattr(jaccard, "FLUSH", 400)
    opened = []
    for n in (120, 240):
        log.write_text("")
        monkeypatch.setattr(exchange.shared, "view", counted)
        texts = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(n)]
        blocks = jaccard.shared.folder(spark, "test")
        docs = spark.createDataFrame(texts, "doc_id long, t string").coalesce(1)
        shards = n // 4
        bits = jaccard._order_bits(shards)
        rows = [b for b in jaccard._ship(blocks, 5, bits, shards)(iter(docs.toArrow().to_batches()))]
        import pyarrow as pa

        table = pa.Table.from_batches(rows).to_pandas()
        answers = [jaccard._frequencies(g) for _, g in table.groupby("shard")]
        import pandas as pd

        done = [jaccard._index(blocks, bits, 80, 100)(g) for _, g in pd.concat(answers).groupby("flush")]
        assert sum(map(len, done)) == n
        opened.append(len(log.read_text().split()))
    assert opened[1] <= 2.2 * opened[0]


def test_long_texts_and_clashing_names(spark):
    """A text above the slice that tasks work on, and columns named like outputs."""
    long = " ".join(f"w{i % 5000}" for i in range(1_700_000))
    df = spark.createDataFrame([(1, long, "x", "y"), (2, "a b", "x", "y")], "doc_id long, text string, payload string, feature string")
    assert len(long) > 8 << 20
    back = {r.doc_id: r for r in media.read_media(media.store_texts(df)).collect()}
    assert back[1].payload[: len(long)] == long.encode() and len(back[2].feature) == 16
    model = lm.train(df)
    got = {r.doc_id: r for r in lm.score(df, model).collect()}
    assert got[1].n_tokens == 1_700_001 and got[1].payload == "x"
