"""URL filters: exact membership from a cascade of Bloom filters.

Level 0 encodes the listed keys; the keys of the complete universe that pass it
wrongly are encoded by level 1, the listed keys that pass level 1 by level 2,
and so on until nothing passes wrongly.  A key of the universe is listed exactly
if the first level that rejects it is an odd one (or if none rejects it and
their number is odd).

Keys are two 64-bit hashes, dealt to shards, so a cascade is built per shard over a
bounded number of keys; the number of shards grows with the universe.  The levels
of a few hundred shards lie in one segment file and a directory says where: a
task gathers up to a million rows, visits each segment that they fall into once (about
two bytes a listed key) and looks them up level by level in whole arrays, without a
step per shard and without a join.

Allow and block rules of (host, path prefix) come first: a rule fits its host
and all subdomains, and the longest one wins.

Defined cases: a null url or one without ``://`` has empty host and path; an
empty universe or an empty list gives no listed key; a key with both marks is listed; repeated rows are judged
alike; an empty table gives no rows; other columns stay (those named as outputs
are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .exchange import arrays, put_arrays, runs, shard_of
from .linededup import Bloom
from .words import mix

KEYS_PER_SHARD, SHARDS_PER_SEGMENT = 4_000, 256
#: Rows that are looked up together (16 bytes each).
GATHERED = 1 << 20
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, *LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    out = None
    for kind, own, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        hit = F.struct(F.lit(own + prefix).alias("rule"), F.lit(kind).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key, null for null."""
    return F.when(key.isNotNull(), F.xxhash64(key)), F.when(key.isNotNull(), F.xxhash64(F.lit(1), key))


def _probe(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """The 64 bits that a level's filter goes by."""
    return mix(a + mix(b + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)))


def build_cascade(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """Levels of filter bits for distinct keys of hashes (a, b), some of them listed."""
    own, levels = np.flatnonzero(listed), []
    other = np.flatnonzero(~listed)
    while len(own):
        bloom = Bloom.of_size(len(own))
        bloom.add(_probe(a[own], b[own], len(levels)))
        levels.append(bloom.bits)
        own, other = other[bloom.has(_probe(a[other], b[other], len(levels) - 1))], own
        if len(levels) > 200:
            raise ValueError("two keys have the same 128 bits of hash and different marks")
    return levels


def _in_levels(a: np.ndarray, b: np.ndarray, place: np.ndarray, levels: int, bits: np.ndarray) -> np.ndarray:
    """Whether the cascades at ``place`` (first byte and length by level, 0 for none) list the keys."""
    out, live = np.zeros(len(a), bool), np.arange(len(a))
    for k in range(levels):
        size = place[live, 2 * k + 1]
        ended = size == 0
        out[live[ended]] = k % 2 == 1
        live, size = live[~ended], size[~ended]
        if not len(live):
            return out
        passed = Bloom(bits, place[live, 2 * k], size).has(_probe(a[live], b[live], k))
        out[live[~passed]] = k % 2 == 1
        live = live[passed]
    out[live] = levels % 2 == 1
    return out


def store_cascade(universe: DataFrame, key: str, listed: str) -> tuple[str, int, set[int]]:
    """Build and store the cascades of a universe of keys: (folder, shards, segments that have keys)."""
    spark = universe.sparkSession
    at = shared.folder(spark, "cascade")
    h, g = key_hashes(F.col(key))
    keys = universe.where(F.col(key).isNotNull()).groupBy(h.alias("a"), g.alias("b")).agg(F.max(F.col(listed)).alias("listed"))
    keys = shared.cut(keys, f"{at}/keys")
    shards = max(4, -(-keys.count() // KEYS_PER_SHARD))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
        own = shard_of(a, shards)
        order = np.argsort(own, kind="stable")
        ends = runs(own[order])
        made, body, at_byte = [], [], 0
        for x, y in zip(ends[:-1], ends[1:]):
            i = order[x:y]
            levels = build_cascade(a[i], b[i], pdf["listed"].to_numpy(bool)[i])
            places = []
            for bits in levels:
                places += [at_byte, len(bits)]
                body.append(bits)
                at_byte += len(bits)
            made.append((int(own[order[x]]), places))
        wide = max(len(p) for _, p in made)
        table = np.zeros((SHARDS_PER_SEGMENT, wide), np.int64)
        first = made[0][0] // SHARDS_PER_SEGMENT * SHARDS_PER_SEGMENT
        for k, p in made:
            table[k - first, : len(p)] = p
        segment = first // SHARDS_PER_SEGMENT
        put_arrays(f"{at}/segment-{segment:06d}", wide=np.array([wide]), table=table, bits=np.concatenate(body) if body else np.zeros(1, np.uint8))
        return pd.DataFrame({"segment": [segment]})

    segment = F.shiftright(F.shiftrightunsigned("a", 32) * shards, 32 + int(np.log2(SHARDS_PER_SEGMENT)))
    made = shared.cut(keys.withColumn("segment", segment).groupBy("segment").applyInPandas(build, "segment long"), f"{at}/made")
    return at, shards, {r.segment for r in made.collect()}  # a number per million keys


def member(stored: tuple[str, int, set[int]]):
    """A function of a key column: whether the key is listed (null: no)."""
    at, shards, have = stored

    def answers(held: list):
        """The answers of gathered batches, each in its place: a segment is opened once for all of them."""
        a, b = (np.concatenate([x[k].to_numpy(np.int64) for x in held]).view(np.uint64) for k in (0, 1))
        out, shard = np.zeros(len(a), bool), shard_of(a, shards)
        segment = shard // SHARDS_PER_SEGMENT
        for k in set(segment.tolist()) & have:
            own = arrays(f"{at}/segment-{k:06d}")
            rows = np.flatnonzero(segment == k)
            wide = int(own["wide"][0])
            table = own["table"].reshape(SHARDS_PER_SEGMENT, wide)
            out[rows] = _in_levels(a[rows], b[rows], table[shard[rows] - k * SHARDS_PER_SEGMENT], wide // 2, own["bits"])
        ends = np.cumsum([0, *[len(x) for x, _ in held]])
        for first, end in zip(ends[:-1], ends[1:]):
            yield pd.Series(out[first:end])

    def in_list(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch[0])
            if n >= GATHERED:
                yield from answers(held)
                held, n = [], 0
        if held:
            yield from answers(held)

    listed = F.pandas_udf(in_list, "boolean")

    def of(key: Column) -> Column:
        a, b = key_hashes(key)
        return key.isNotNull() & listed(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))

    return of


def filter_urls(pages: DataFrame, listed_hosts: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``listed_hosts``: (host, listed) of every host of the corpus, once each; a url
    without a fitting rule is blocked if its host is listed.
    """
    out = pages.drop("host", "path", "rule", "verdict")
    keep = out.columns
    member_of = member(store_cascade(listed_hosts, "host", "listed"))
    out = out.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    out = out.withColumns({"__r": rule_verdict(F.col("host"), F.col("path"), rules), "__m": member_of(F.col("host"))})
    return out.select(*keep, "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), F.when(F.col("__m"), "block").otherwise("allow")).alias("verdict"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6(spark, sf_dir: str) -> DataFrame:
    """The list: hosts that the corpus never shows over https."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    secure = F.col("url").startswith("https://")
    hosts = pages.groupBy(url_host(F.col("url")).alias("host")).agg((~F.max(F.coalesce(secure, F.lit(False)))).alias("listed"))
    return filter_urls(pages, hosts, RULES).select("page_id", "host", "path", "rule", "verdict")
