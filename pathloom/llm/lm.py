"""LM scoring: an interpolated modified Kneser-Ney model of any order.

Counting.  Tasks store their tokens as codes of their own distinct words and ask
hash shards about these words (``exchange``).  A word shard merges what it is asked
into one sorted hash array with counts and gives each word an id, small for frequent
words.  Tasks then ship their distinct n-grams as ids, in blocks; a shard of the
highest order merges them into a sorted hash array of keys and counts, and passes on,
for the order below, how many n-grams each of its suffixes ends and how many follow
each of its prefixes.  The shards of the lower orders merge these down to single
words.  An n-gram goes by its own hash, so no frequent word or context is one task's
work; a shard's sums over contexts are partial and are merged by the order below.

Scoring.  The same questions are asked of the stored arrays: a shard's task maps
its one array and answers the n-grams that tasks ship to it; a flush of documents is
put together in one task from its answers.  No task opens all arrays, and nothing of
the model passes through the driver but a row of totals per order.

The model, for an order n, n - 1 start marks before each text and an end token
after it, counts a_n(g) of n-grams and a_k(g), the number of distinct tokens before
g, for shorter ones:

    p_k(w | h) = max(a_k(h w) - D_k(a), 0) / T_k(h) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / T_k(h) * p_k-1(w | h')

T_k(h) is the sum of a_k(h w) over w, h' is h without its first token; where T_k(h)
is 0, p_k-1 stands alone; p_0 = 1 / (V + 1) for V known tokens and one unknown.
So probabilities sum to 1 over the V + 1 tokens in every context.

Defined cases: a null or empty text is the end token alone; no training documents
leave V = 0 and every token unknown with probability 1; repeated rows count each
time; an empty table gives no rows; other columns stay (those named as outputs are
replaced).  Words and n-grams are identified by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .exchange import BLOCK, KIND, Blocks, arrays, back, cells, count, deal, find, flush_name, gathered, narrow, pack, put_arrays, runs, shard_of, span_of, sum_by, unpack
from .words import hashed_words, mix, slices

#: Tokens that a task holds before it ships blocks; what one shard is meant for.
FLUSH, DOCS_PER_WORD_SHARD, TOKENS_PER_SHARD = 1 << 20, 50_000, 2 << 20
END = np.uint64(0x5BD1E995A5A5F00D)
#: Ids of the start mark and of unknown words; known words have larger ones.
START, UNKNOWN, FIRST = np.uint64(0), np.uint64(1), 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the end token after each text, pointers)."""
    h, ptr = hashed_words(texts)
    return np.insert(h, ptr[1:], END), ptr + np.arange(len(ptr))


def gram_key(ids: list[np.ndarray]) -> np.ndarray:
    """Hash of each n-gram, from the columns of its ids."""
    out = mix(ids[0] + np.uint64(len(ids)))
    for c in ids[1:]:
        out = mix(out * _GOLDEN + c)
    return out


@dataclass(frozen=True)
class Model:
    """Where a trained model lies, and its totals."""

    at: str
    order: int
    tokens: int  # N
    words: int  # V
    word_shards: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]  # of orders 1 to n
    unigrams: tuple[int, int, int, int]  # T, N1, N2, N3+ of the empty context


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items that occur once to four times.

    Where the estimate is undefined or not between 0 and k, D is half of k, so that
    every context leaves something to tokens that it has not had.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(x if 0 < x < k and n[k] else k / 2 for k, x in zip((1, 2, 3), d))


def _ask_words(at: str, shards: int, text: str, counted: bool):
    """Documents to blocks of their distinct words (with counts, if asked); tokens and other columns are stored."""
    span = span_of(shards)

    def run(batches):
        held, tables, n, number = [], [], 0, 0

        def flush():
            h, sizes = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            kinds, codes, times = np.unique(h, return_inverse=True, return_counts=True)
            name = flush_name(number, h, sizes)
            rank = np.empty(len(kinds), np.int64)  # frequent words have small codes, which pack best
            rank[np.argsort(-times, kind="stable")] = np.arange(len(kinds))
            sink = pa.BufferOutputStream()
            rest = pa.Table.from_batches(tables)
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            put_arrays(f"{at}/tokens-{name}", sizes=sizes, count=np.array([len(kinds), len(codes)]), codes=np.frombuffer(pack(rank[codes]), np.uint8), ranks=np.frombuffer(pack(rank), np.uint8), rest=np.frombuffer(sink.getvalue(), np.uint8))
            return cells(name, shard_of(kinds, shards), kinds, *([times] if counted else []), span=span)

        for batch in batches:
            i = batch.schema.get_field_index(text)
            for a, b in slices(batch.column(i)):
                h, ptr = _tokens(batch.column(i)[a:b])
                held.append((h, np.diff(ptr)))
                tables.append(batch.slice(a, b - a).remove_column(i))
                n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, tables, n, number = [], [], 0, number + 1
        if n:
            yield flush()

    return run


def _merge_words(at: str, shards: int):
    """A word shard's blocks to its stored array; each word is answered by its id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = Blocks(pdf, 2)
        keys, counts = sum_by(*blocks.columns)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(keys))
        ids = FIRST + rank * shards + blocks.shard
        put_arrays(f"{at}/words-{blocks.shard:06d}", keys=keys, ids=narrow(ids), counts=narrow(counts))
        total = pd.DataFrame({"shard": [-1], "flush": [""], "n": [0], "block": [np.array([len(keys), counts.sum()], "<i8").tobytes()]})
        return pd.concat([blocks.answers(ids[find(keys, blocks.columns[0])[0]].astype(np.uint64)), total])

    return run


def _find_words(at: str, shards: int):
    """A word shard's blocks answered by the stored array: id and count, 1 and 0 where it has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = Blocks(pdf, 1)
        ids, counts = np.full(len(blocks.columns[0]), UNKNOWN), np.zeros(len(blocks.columns[0]), np.uint64)
        if shared.exists(f"{at}/words-{blocks.shard:06d}"):
            stored = arrays(f"{at}/words-{blocks.shard:06d}")
            i, hit = find(stored["keys"], blocks.columns[0])
            ids[hit], counts[hit] = stored["ids"][i[hit]], stored["counts"][i[hit]]
        return blocks.answers(ids, counts)

    return run


def _words(stored: dict) -> np.ndarray:
    """Place of each token's word among the flush's distinct words, as they were asked."""
    (codes,) = unpack(stored["codes"].tobytes(), int(stored["count"][1]), 1)
    (ranks,) = unpack(stored["ranks"].tobytes(), int(stored["count"][0]), 1)
    place = np.empty(len(ranks), np.int64)
    place[ranks.astype(np.int64)] = np.arange(len(ranks))
    return place[codes.astype(np.int64)]


def _states(ids: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """The columns of the ``width``-grams that end at each place; every text has one place before its first token."""
    last = np.insert(ids, np.cumsum(sizes) - sizes, START)
    in_text = np.arange(len(last)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    out = []
    for back in range(width - 1, -1, -1):
        c = np.full(len(last), START)
        c[back:] = last[: len(last) - back]
        c[in_text < back] = START
        out.append(c)
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted keys, a place of each, number of each key among them)."""
    order = np.argsort(key)
    at = runs(key[order])
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return key[order[at[:-1]]], order[at[:-1]], of


def _numbers(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers that are mostly small, as a byte each; those from 255 on stand apart."""
    large = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": narrow(large), f"{name}_large": narrow(values[large])}


def _number(stored: dict, name: str, at: np.ndarray) -> np.ndarray:
    out = stored[name][at].astype(np.uint64)
    large = np.flatnonzero(out == 255)
    out[large] = stored[f"{name}_large"][np.searchsorted(stored[f"{name}_at"], at[large].astype(stored[f"{name}_at"].dtype))]
    return out


def _is_token(sizes: np.ndarray) -> np.ndarray:
    out = np.ones(int(sizes.sum()) + len(sizes), bool)
    out[np.cumsum(sizes + 1) - sizes - 1] = False
    return out


def _by_ids(shard: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """Order by shard and then by the ids, column by column."""
    columns = [shard.astype(np.uint64), *ids]
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    one = columns[0]
    for c, b in zip(columns[1:], bits[1:]):
        one = one << np.uint64(b) | c
    return np.argsort(one)


def _gram_cells(name: str, shards: int, span: int, key: np.ndarray, ids: list[np.ndarray], times: np.ndarray | None = None) -> pa.RecordBatch:
    """Blocks of distinct n-grams: within a shard in the order of their ids, which packs best."""
    shard = shard_of(key, shards)
    o = _by_ids(shard, ids)
    return cells(name, shard[o], *[c[o] for c in ids], *([] if times is None else [times[o]]), span=span)


def _count_grams(work: str, order: int, shards: int):
    """A flush's word ids to blocks of its distinct n-grams with counts."""
    span = span_of(shards)

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        name = pdf["flush"].iloc[0]
        stored = arrays(f"{work}/tokens-{name}")
        (ids,) = gathered(pdf, 1, int(stored["count"][0]))
        sizes = stored["sizes"]
        grams = [c[_is_token(sizes)] for c in _states(ids[_words(stored)], sizes, order)]
        key = gram_key(grams)
        order_ = np.argsort(key)
        at = runs(key[order_])
        first = order_[at[:-1]]
        return pa.Table.from_batches([_gram_cells(name, shards, span, key[first], [c[first] for c in grams], np.diff(at))])

    return run


def _grams_of(level: int, top: bool, shards: int):
    """How many columns a block of ``level``-grams has, and the shards of its grams."""
    return lambda _: level + (1 if top else 5), lambda _, own: shard_of(gram_key(own[:level]), shards)


def _merge_grams(at: str, level: int, top: bool, shards: int):
    """A shard's blocks of ``level``-grams to its stored array, and to blocks of the order below.

    Fields of a gram: its count a, and as a context T, N1, N2, N3+ (not at the top).
    Shard -1 has the reports of the orders above, which pass.
    """
    fields, span = 1 if top else 5, span_of(shards)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["shard"].iloc[0] < 0:
            return pdf
        blocks = Blocks(pdf, level + fields)
        grams, values = blocks.columns[:level], blocks.columns[level:]
        key = gram_key(grams)
        order = np.argsort(key)
        at_ = runs(key[order])
        first = order[at_[:-1]]
        keys, grams = key[first], [c[first] for c in grams]
        a, *context = [np.add.reduceat(v[order], at_[:-1]) for v in values]
        put_arrays(f"{at}/grams-{level}-{blocks.shard:06d}", keys=keys, **_numbers("a", a), **{k: v for i, c in enumerate(context) for k, v in _numbers(f"c{i}", c).items()})
        real = a > 0
        report = np.array([level, *[(a == k).sum() for k in (1, 2, 3, 4)], a.sum(), (a > 2).sum()], "<i8").tobytes()
        out = [pd.DataFrame({"shard": [-1], "flush": [""], "n": [0], "block": [report]})]
        if level > 1:
            grams, a = [c[real] for c in grams], a[real]
            one = np.ones(len(a), np.uint64)
            none = np.zeros(len(a), np.uint64)
            # As suffix each gram counts once; as prefix it gives its count to T and one to N1, N2 or N3+.
            below = [np.concatenate(x) for x in zip(grams[1:], grams[:-1])]
            parts = [np.concatenate(x) for x in ((one, none), (none, a), (none, a == 1), (none, a == 2), (none, a > 2))]
            k2 = gram_key(below)
            order = np.argsort(k2)
            at_ = runs(k2[order])
            first = order[at_[:-1]]
            sums = [np.add.reduceat(p[order].astype(np.uint64), at_[:-1]) if len(first) else none[:0] for p in parts]
            below, k2 = [c[first] for c in below], k2[first]
            shard = shard_of(k2, shards)
            o = _by_ids(shard, below)
            out.append(cells("", shard[o], *[c[o] for c in below], *[s[o] for s in sums], span=span).to_pandas())
        return pd.concat(out)

    return run


def _summed(reports: DataFrame, numbers: int, by_first: bool) -> list[tuple[int, ...]]:
    """The sums of the reports' numbers, over all or for each value of the first; one row or a row per order reaches the driver."""
    names = [f"c{k}" for k in range(numbers)]

    def read(batches):
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, numbers)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=names)

    rows = reports.select("block").mapInArrow(read, ", ".join(f"{c} long" for c in names))
    keys = names[:1] if by_first else []
    return [tuple(x or 0 for x in r) for r in rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names[len(keys) :]]).collect()]


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count the model of ``docs``; its arrays stay in the shared folder."""
    if order < 1:
        raise ValueError("the order must be positive")
    spark = docs.sparkSession
    at = shared.folder(spark, "lm")
    docs = docs.select(F.col(text).alias("text"))
    with shared.scratch(spark):
        work = shared.folder(spark, "lm-tokens")
        word_shards = max(4, -(-docs.count() // DOCS_PER_WORD_SHARD))
        asked = docs.mapInArrow(_ask_words(work, word_shards, "text", True), BLOCK)
        asked = deal(asked, f"{work}/asked", word_shards, lambda _: 2, lambda _, own: shard_of(own[0], word_shards))
        answered = shared.cut(asked.groupBy("shard").applyInPandas(_merge_words(at, word_shards), BLOCK), f"{work}/words")
        words, tokens = _summed(answered.where("shard < 0"), 2, by_first=False)[0]
        shards = max(8, -(-tokens // TOKENS_PER_SHARD))
        words_back = back(answered.where("shard >= 0"), f"{work}/asked", word_shards, lambda _: 1)
        rows = words_back.groupBy("flush").applyInArrow(_count_grams(work, order, shards), BLOCK)
        for level in range(order, 0, -1):
            rows = deal(rows, work, shards, *_grams_of(level, level == order, shards), answered=False)
            rows = rows.groupBy("shard").applyInPandas(_merge_grams(at, level, level == order, shards), BLOCK)
        totals = np.zeros((order, 6), np.int64)
        for level, *own in _summed(shared.cut(rows, f"{work}/reports"), 7, by_first=True):
            totals[level - 1] = own
    t, n1, n2, n3 = (int(totals[0][k]) for k in (4, 0, 1, 5))
    return Model(at, order, tokens, words, word_shards, shards, tuple(discounts(x[:4].tolist()) for x in totals), (t, n1, n2, n3))


SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _ask_grams(work: str, model: Model):
    """A flush's word answers to blocks of its distinct grams of every order; the answers are stored."""
    span = span_of(model.shards)

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        name = pdf["flush"].iloc[0]
        stored = arrays(f"{work}/tokens-{name}")
        ids, counts = gathered(pdf, 2, int(stored["count"][0]))
        put_arrays(f"{work}/ids-{name}", both=np.frombuffer(pack(ids, counts), np.uint8))
        out = []
        for level, key, grams in _questions(stored, ids, model.order):
            kinds = _distinct(key)[1]
            got = _gram_cells(name, model.shards, span, key[kinds], [c[kinds] for c in grams])
            # Columns of other orders are other in number: a block says its own by its kind, the order.
            got = got.set_column(0, "shard", pa.array(got.column(0).to_numpy() + level * KIND))
            out.append(got)
        return pa.Table.from_batches(out)

    return run


def _questions(stored: dict, ids: np.ndarray, order: int):
    """(order, key, id columns) of the grams whose numbers a flush needs."""
    own = ids[_words(stored)]
    for level in range(1, order + 1):
        grams = _states(own, stored["sizes"], level)
        if level == order:  # no contexts of this length
            grams = [c[_is_token(stored["sizes"])] for c in grams]
        yield level, gram_key(grams), grams


def _find_grams(at: str, order: int):
    """A shard's questions answered by its stored array: a, and below the top T, N1, N2, N3+; 0 where it has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level, shard = divmod(int(pdf["shard"].iloc[0]), KIND)
        blocks = Blocks(pdf, level)
        key = gram_key(blocks.columns)
        out = [np.zeros(len(key), np.uint64) for _ in range(1 if level == order else 5)]
        if shared.exists(f"{at}/grams-{level}-{shard:06d}"):
            stored = arrays(f"{at}/grams-{level}-{shard:06d}")
            i, hit = find(stored["keys"], key)
            for o, c in zip(out, ("a", "c0", "c1", "c2", "c3")):
                if c in stored:
                    o[hit] = _number(stored, c, i[hit])
        return blocks.answers(*out)

    return run


def _finish(work: str, model: Model, names: list[str]):
    """A flush's answers to its documents' sums."""

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        name = pdf["flush"].iloc[0]
        stored = arrays(f"{work}/tokens-{name}")
        ids, counts = unpack(arrays(f"{work}/ids-{name}")["both"].tobytes(), int(stored["count"][0]), 2)
        sizes, token = stored["sizes"], _is_token(stored["sizes"])
        p = np.full(int(sizes.sum()), 1 / (model.words + 1))
        context = [np.full(len(p), float(x)) for x in model.unigrams]
        for level, key, grams in _questions(stored, ids, model.order):
            own = pdf[pdf["shard"] // KIND == level]
            kinds, first, of = _distinct(key)
            got = gathered(own, 1 if level == model.order else 5, len(kinds))
            # Answers come in the order in which the grams were shipped.
            shipped = _by_ids(shard_of(kinds, model.shards), [c[first] for c in grams])
            place = np.empty(len(kinds), np.int64)
            place[shipped] = np.arange(len(kinds))
            got = [g[place][of] for g in got]
            a = got[0] if level == model.order else got[0][token]
            d = np.array([0.0, *model.discounts[level - 1]])
            total, n1, n2, n3 = context
            seen = np.maximum(total, 1)
            found = np.maximum(a - d[np.minimum(a, 3).astype(np.int64)], 0) / seen
            p = np.where(total > 0, found + (d[1] * n1 + d[2] * n2 + d[3] * n3) / seen * p, p)
            if level < model.order:  # the gram that ends before a token is its context
                before = np.flatnonzero(token) - 1
                context = [g[before].astype(np.float64) for g in got[1:]]
        c = counts[_words(stored)].astype(np.float64)
        base = np.log10((c + 1) / (model.tokens + model.words + 1))
        at = np.cumsum(sizes) - sizes
        known, base, own = (np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64), base, np.log10(p)))
        rest = pa.ipc.open_stream(pa.py_buffer(stored["rest"].tobytes())).read_all().select(names)
        made = [pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.tokens)), pa.array(base), pa.array(own)]
        return pa.Table.from_arrays([*rest.columns, *made], names=[*names, *SCORES])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score (sums of log10)."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (text, *SCORES)]
    zero, real = F.lit(0).cast("long"), F.lit(0.0)
    schema = docs.select(*names, *[(real if c.endswith("score") else zero).alias(c) for c in SCORES]).schema
    result = shared.folder(spark, "lm-scores")
    with shared.scratch(spark):
        work = shared.folder(spark, "lm-tokens")
        words = docs.select(*names, text).mapInArrow(_ask_words(work, model.word_shards, text, False), BLOCK)
        words = deal(words, f"{work}/words", model.word_shards, lambda _: 1, lambda _, own: shard_of(own[0], model.word_shards))
        words = back(words.groupBy("shard").applyInPandas(_find_words(model.at, model.word_shards), BLOCK), f"{work}/words", model.word_shards, lambda _: 2)
        grams = words.groupBy("flush").applyInArrow(_ask_grams(work, model), BLOCK)
        grams = deal(grams, f"{work}/grams", model.shards, lambda level: level, lambda level, own: shard_of(gram_key(own), model.shards))
        grams = grams.groupBy("shard").applyInPandas(_find_grams(model.at, model.order), BLOCK)
        grams = back(grams, f"{work}/grams", model.shards, lambda level: 1 if level == model.order else 5)
        return shared.cut(grams.groupBy("flush").applyInArrow(_finish(work, model, names), schema), result)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.withColumn("held_out", held)
    model = train(docs.where(~F.col("held_out")))
    return score(docs, model)
