"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens at places that no vocabulary entry spans, so its count is
the sum of theirs.  The most frequent pre-tokens and their lengths in tokens are
broadcast as one compact hash table; all others go through a bounded cache of the
worker, and only what that lacks is encoded.  No pre-token is shuffled.

The table is chosen from all documents: a task sums its pre-tokens, forgetting the
rarest where there are too many, and passes on the ``TABLE`` most frequent as one row;
groups of such rows are summed until one is left.  It decides about speed alone, and
its size is bounded by ``TABLE`` entries of at most ``LONGEST`` bytes (0.3 MB).

``breaks_of`` reads from the tokenizer's model where texts may be cut; for a model that
allows no cuts, whole texts are encoded.  Tokenizers in ``.json`` files go through
``encode.Encoder``, which cuts and caches by that library's rules.

Defined cases: a null or empty text has no tokens; repeated rows and ids stay rows of
their own; an empty table gives no rows; columns other than key and text are not
returned; a text longer than ``SLICE`` is counted window by window.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .encode import SLICE, encoder
from .words import buffers, slices

TABLE, LONGEST, MERGED = 8_192, 32, 64
CACHED = 250_000
_SPACE, _LINE = 0x20, 0x0A
#: UTF-8 form of the sign that stands for a space in vocabularies.
_MARK = "▁"


def breaks_of(path: str) -> tuple[int, ...]:
    """The bytes before which a run of other bytes may be cut off; empty: encode whole texts."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    how, norm = model.trainer_spec, model.normalizer_spec
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
    kinds = {p.type for p in model.pieces}
    if how.model_type != how.BPE or how.treat_whitespace_as_suffix or not plain or model.SentencePiece.USER_DEFINED in kinds:
        return ()
    spanned = {b for p in model.pieces for a, b in zip(p.piece, p.piece[1:]) if a != b}
    return () if _MARK in spanned else (_SPACE,) if "\n" in spanned else (_SPACE, _LINE)


def cut_places(raw: np.ndarray, starts: np.ndarray, breaks: tuple[int, ...]) -> np.ndarray:
    """First bytes of the pre-tokens: each start, and each break byte after another byte."""
    cut = np.zeros(len(raw), bool)
    cut[1:] = np.isin(raw[1:], breaks) & (raw[1:] != raw[:-1])
    after = np.flatnonzero(cut[3:] & (raw[3:] == _SPACE) & (raw[2:-1] == 0x81)) + 3  # the mark itself and a space are one run
    cut[after[(raw[after - 2] == 0x96) & (raw[after - 3] == 0xE2)]] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def pre_tokens(raw: np.ndarray, offs: np.ndarray, breaks: tuple[int, ...]) -> tuple[pa.Array, np.ndarray]:
    """(all pre-tokens, pointers); a text's first one has the space that the library puts before a text."""
    full = np.flatnonzero(offs[1:] > offs[:-1])
    raw = np.insert(raw, offs[full], _SPACE)
    offs = offs + np.concatenate([[0], np.cumsum(offs[1:] > offs[:-1])])
    at = cut_places(raw, offs[full], breaks)
    ends = np.append(at, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]), np.searchsorted(at, offs)


def windows(texts: pa.Array, breaks: tuple[int, ...], most: int):
    """(first row, end row, pre-tokens, pointers) of runs of rows of about ``most`` bytes; of a longer text one window after the other."""
    for a, b in slices(texts, most):
        raw, offs = buffers(texts[a:b])
        if b - a > 1 or len(raw) <= 2 * most:
            yield (a, b, *pre_tokens(raw, offs, breaks))
            continue
        first = 0
        while first < len(raw):
            end, size = len(raw), most
            while first + size < len(raw):
                # The window ends at its last cut; one without a cut is doubled.
                inside = cut_places(raw[first : first + size], np.zeros(0, np.int64), breaks)
                if len(inside) and inside[-1]:
                    end = first + int(inside[-1])
                    break
                size *= 2
            found, ptr = pre_tokens(raw[first:end], np.array([0, end - first]), breaks)
            if first:  # only the text's first window begins with a space that it doesn't have
                values = found.to_pylist()
                values[:1] = [values[0][1:]] if raw[first] == _SPACE else []
                found = pa.array(values, pa.binary())
                ptr = np.array([0, len(found)])
            yield a, b, found, ptr
            first = end


class Lengths:
    """Lengths in tokens of pre-tokens: a table of frequent ones, then a cache of two generations, then the library."""

    def __init__(self, path: str, table: tuple[pa.Array, np.ndarray] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = table
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def encoded(self, values: list[bytes]) -> list[int]:
        """Lengths of pre-tokens that the library counts; it puts a space before each text."""
        texts = [v[1:] if v[0] == _SPACE else v for v in values]
        got = self.model.encode([t.decode("utf-8") for t in texts], num_threads=1)
        return [self.space if v == b" " else len(ids) - (self.space if v[0] != _SPACE else 0) for v, ids in zip(values, got)]

    def of(self, values: pa.Array) -> np.ndarray:
        """Lengths of distinct pre-tokens."""
        out, missing = np.zeros(len(values), np.int64), np.arange(len(values))
        if self.table is not None:
            at = pc.index_in(values, value_set=self.table[0])
            found = at.is_valid().to_numpy(zero_copy_only=False)
            out[found] = self.table[1][at.drop_null().to_numpy()]
            missing = np.flatnonzero(~found)
        names = values.take(pa.array(missing)).to_pylist()
        new = []
        for i, v in zip(missing.tolist(), names):
            n = self.young.get(v)
            if n is None:
                n = self.old.get(v)
                if n is None:
                    new.append((i, v))
                    continue
                self._keep(v, n)
            out[i] = n
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            for (i, v), n in zip(part, self.encoded([v for _, v in part])):
                out[i] = n
                self._keep(v, n)
        return out

    def _keep(self, v: bytes, n: int) -> None:
        if len(v) <= 8 * LONGEST:
            if len(self.young) >= CACHED // 2:
                self.old, self.young = self.young, {}
            self.young[v] = n


def _top(counts: dict, most: int) -> dict:
    return counts if len(counts) <= most else dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])


FREQUENT = "part long, words array<binary>, counts array<long>"


def _row(part: int, counts: dict, most: int) -> pa.Table:
    top = _top(counts, most)
    return pa.table({"part": pa.array([part], pa.int64()), "words": pa.array([list(top)], pa.list_(pa.binary())), "counts": pa.array([list(top.values())], pa.list_(pa.int64()))})


def frequent(docs: DataFrame, breaks: tuple[int, ...], text: str = "text", most: int = TABLE, merged_rows: int = MERGED) -> list[bytes]:
    """At most ``most`` pre-tokens, the most frequent in sums over all documents."""

    def summed(batches):
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for _, _, found, _ in windows(batch.column(0), breaks, SLICE):
                coded = found.dictionary_encode()
                short = pc.less_equal(pc.binary_length(coded.dictionary), LONGEST)
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))[short.to_numpy(zero_copy_only=False)]
                counts.update(dict(zip(coded.dictionary.filter(short).to_pylist(), n.tolist())))
                if len(counts) > 32 * most:
                    counts = Counter(_top(counts, 16 * most))
        yield from _row(TaskContext.get().partitionId(), counts, most).to_batches()

    def merged(table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for words, n in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
            counts.update(dict(zip(words, n)))
        return _row(table.column("part")[0].as_py() // merged_rows, counts, most)

    spark = docs.sparkSession
    rows = shared.cut(docs.select(text).mapInArrow(summed, FREQUENT), shared.folder(spark, "frequent"))
    while (rows.agg(F.max("part").alias("m")).first().m or 0) > 0:
        rows = shared.cut(rows.groupBy(F.expr(f"part div {merged_rows}")).applyInArrow(merged, FREQUENT), shared.folder(spark, "frequent"))
    last = rows.collect()  # one row of short entries
    return [bytes(w) for r in last for w in r.words]


_workers: dict[str, Lengths] = {}


def lengths(path: str) -> Lengths:
    """The worker's lengths for a tokenizer file; they live as long as the worker."""
    if path not in _workers:
        _workers[path] = Lengths(path)
    return _workers[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every document by the tokenizer of a ``.model`` or ``.json`` file."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    breaks = breaks_of(path) if path.endswith(".model") else ()
    table = None
    if breaks:
        words = sorted(frequent(docs, breaks, text))
        if words:
            table = spark.sparkContext.broadcast((pa.array(words, pa.binary()), np.array(Lengths(path).encoded(words), np.uint16)))

    def whole(texts: pa.Array) -> np.ndarray:
        if path.endswith(".json"):
            return np.diff(encoder(path).encode(texts)[1])
        return np.array([len(lengths(path).model.encode(t or "")) for t in texts.to_pylist()], np.int64)

    def pieces(texts: pa.Array) -> np.ndarray:
        own, out = lengths(path), np.zeros(len(texts), np.int64)
        own.table = table.value if table is not None else None
        for a, b, found, ptr in windows(texts, breaks, SLICE):
            coded = found.dictionary_encode()
            ends = np.concatenate([[0], np.cumsum(own.of(coded.dictionary)[coded.indices.to_numpy()])]) if len(found) else np.zeros(1, np.int64)
            out[a:b] += ends[ptr[1:]] - ends[ptr[:-1]]
        return out

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            _, offs = buffers(texts)
            parts = [whole(texts[a:b]) for a, b in slices(texts, SLICE)] if not breaks else [pieces(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))], names=[key, "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
