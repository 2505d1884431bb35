"""Keys shipped to very many shards: results, block lengths, and names that a repeated task gives again."""

import time

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import exchange, jaccard, linededup, lm, shared


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def few(monkeypatch):
    """Small documents in many shards, which flushes reach by groups of them."""
    monkeypatch.setattr(jaccard, "DOCS_PER_SHARD", 3)
    monkeypatch.setattr(linededup, "DOCS_PER_SHARD", 3)
    monkeypatch.setattr(lm, "DOCS_PER_WORD_SHARD", 3)
    monkeypatch.setattr(lm, "TOKENS_PER_SHARD", 400)

    def then(fan):
        monkeypatch.setattr(exchange, "FAN", fan)
        monkeypatch.setattr(exchange, "BATCH", 700)

    return then


@pytest.mark.parametrize("name", ["jaccard", "lines", "model 2", "model 3"])
def test_groups_of_shards_change_no_result(spark, awkward, empty, few, name):
    def run(docs):
        if name == "jaccard":
            return _rows(jaccard.similar_documents(docs, 3, 90, 100))
        if name == "lines":
            return _rows(linededup.dedup_lines(docs, 5).select("doc_id", "text", "n_lines", "n_dropped"))
        # Sums of the same numbers in another order differ in the last digits.
        model = lm.train(docs.where("coalesce(doc_id, 0) % 3 > 0"), order=int(name[-1]))
        found = lm.score(docs, model).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
        return sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))) for r in found)

    few(1 << 20)
    plain = run(awkward)
    few(4)
    assert exchange.span_of(24) == 6
    assert run(awkward) == plain
    assert run(empty) == []


def _flushes(groups, flushes, keys, span, shards, rng):
    """Blocks that ``flushes`` flushes ship to the first group of shards."""
    top = np.uint64(2**64 // groups - 1)
    for k in range(flushes):
        h = np.sort(rng.integers(0, top, keys, dtype=np.uint64, endpoint=True))
        yield exchange.cells(f"{k:06d}", exchange.shard_of(h, shards), h, span=span)


def _size(batches):
    return sum(len(b) + 46 + 48 for t in batches for b in t.column(3).to_pylist())  # a row's other columns


def test_blocks_stay_long_with_many_shards(spark):
    """Bytes a key, both ways of routing, at 64, 262,144 and 2,097,152 shards."""
    rng, cost = np.random.default_rng(1), {}
    for shards in (64, 1 << 18, 1 << 21):
        span = exchange.span_of(shards)
        if span == 1:
            h = np.sort(rng.integers(0, 2**64, 1 << 20, dtype=np.uint64))
            begin = time.process_time()
            shipped = [exchange.cells("0" * 46, exchange.shard_of(h, shards), h)]
            cost[shards] = _size(shipped) / len(h), (time.process_time() - begin) / len(h)
            continue
        shipped = list(_flushes(exchange.FAN, exchange.FAN, 512, span, shards, rng))
        begin = time.process_time()
        run = exchange._dealing(shared.folder(spark, "test"), lambda _: 1, lambda _, own: exchange.shard_of(own[0], shards), True, exchange.BATCH)
        dealt = [b for b in run(iter(shipped)) if b.num_rows]
        keys = sum(sum(b.column(2).to_pylist()) for b in dealt)
        assert keys == exchange.FAN * 512
        assert len({s for b in dealt for s in b.column(0).to_pylist()}) == span
        cost[shards] = (_size(shipped) + _size(dealt)) / keys, (time.process_time() - begin) / keys
    print(cost)
    for shards in (1 << 18, 1 << 21):
        # Two shuffles instead of one, and no more than that.
        assert cost[shards][0] < 2.2 * cost[64][0]
        assert cost[shards][1] < 2e-6


def test_dealt_answers_return_to_their_flushes(spark, few):
    few(4)
    shards, rng = 40, np.random.default_rng(2)
    span = exchange.span_of(shards)
    asked = {f"{k:06d}": np.sort(rng.integers(0, 2**64, 50, dtype=np.uint64)) for k in range(12)}
    cut = [exchange.cells(name, exchange.shard_of(h, shards), h, span=span) for name, h in asked.items()]
    at = shared.folder(spark, "test")
    rows = spark.createDataFrame(pa.Table.from_batches(cut).to_pandas(), exchange.BLOCK)
    dealt = exchange.deal(rows, at, shards, lambda _: 1, lambda _, own: exchange.shard_of(own[0], shards))

    def answer(pdf):
        blocks = exchange.Blocks(pdf, 1)
        assert set(exchange.shard_of(blocks.columns[0], shards).tolist()) == {blocks.shard}
        return blocks.answers(blocks.columns[0] >> np.uint64(1))

    answers = exchange.back(dealt.groupBy("shard").applyInPandas(answer, exchange.BLOCK), at, shards, lambda _: 1).toPandas()
    for name, h in asked.items():
        (got,) = exchange.gathered(answers[answers["flush"] == name], 1, len(h))
        assert (got == h >> np.uint64(1)).all()
    first, again = (sorted(r.flush for r in dealt.select("flush").distinct().collect()) for _ in range(2))
    assert first == again  # the same names, whatever order the shuffle brings the rows in


@pytest.mark.parametrize("ahead", [1, 90, 1 << 20])
def test_lists_read_each_set_once_and_file_by_file(spark, monkeypatch, ahead):
    """40 lists of the same 6 sets of 3 files: one read of a set for all lists that are read together, and links as before."""
    at = shared.folder(spark, "test")
    sets = [np.arange(10 * k, 10 * k + 30, dtype="<u8") for k in (0, 0, 3, 3, 9, 9)]
    sets = [np.append(s, np.uint64(1000 + k)) for k, s in enumerate(sets)]  # pairs share 30 of 32
    for f in range(3):
        shared.put(f"{at}/sets-{f}", [sets[2 * f].tobytes(), sets[2 * f + 1].tobytes()])
    rows = [(t, 0, 0, 0, bytes([k]), 31, 0, str(k // 2), 248 * (k % 2), bytes([k])) for t in range(40) for k in (4, 1, 3, 0, 5, 2)]
    names = ["token", "left", "right", "own", "node", "n", "pos", "file", "at", "part"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    asked, piece = [], shared.piece
    monkeypatch.setattr(jaccard.shared, "piece", lambda uri, *rest: asked.append(uri) or piece(uri, *rest))
    monkeypatch.setattr(jaccard, "READ", ahead)
    found = {tuple(r.values()) for b in jaccard._links(at, 90, 100)(iter([batch.slice(0, 100), batch.slice(100)])) for r in b.to_pylist()}
    assert found == {(b"\x01", b"\x00"), (b"\x03", b"\x02"), (b"\x05", b"\x04")}
    if ahead == 1 << 20:
        assert len(asked) == 18 and asked[:6] == sorted(asked[:6])  # of two batches and the rest
    else:
        assert len(asked) == 240
