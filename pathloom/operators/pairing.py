"""Which path schemas explain known pairs, and training samples derived from them.

A schema's paths are reduced to counts per (start, end, month) once; path cover,
pair cover and summary all come from that one aggregate and the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import TIME, PathSchema
from ..sources.io import stored
from .paths import Factored

PAIR = ("start", "end", TIME)
#: A node that at most so many starts reach, or that reaches at most so many ends, has its pairs listed: at most so many times its edges.
LIGHT = 32
#: Pairs that a task makes of a node's starts and ends, and the most tasks.
TASK_PAIRS, TASKS = 1 << 22, 20_000
#: Ends that a list of a large node's ends holds, on average.
CHUNK = 4096
#: The most known ends that a start carries along; pairs of others are labelled by a join.
CARRIED = 64


def ends(schema: PathSchema, path: DataFrame) -> DataFrame:
    return path.select(F.col("Node_0").alias("start"), F.col(schema.end).alias("end"), TIME)


def _fits(schema: PathSchema, start_type: str | None, end_type: str | None) -> None:
    if (start_type and schema.start_type != start_type) or (end_type and schema.end_type != end_type):
        raise ValueError(f"pairs of {start_type}-{end_type} don't fit the path {schema.name}")


def path_cover(schema: PathSchema, path: DataFrame, pairs: DataFrame, start_type: str | None = None, end_type: str | None = None) -> DataFrame:
    """Paths with ``cover_mark``: whether they connect a known pair."""
    _fits(schema, start_type, end_type)
    known = pairs.select(*[F.col(c).alias(f"__{c}") for c in PAIR]).distinct()
    on = (F.col("Node_0") == F.col("__start")) & (F.col(schema.end) == F.col("__end")) & (F.col(TIME) == F.col(f"__{TIME}"))
    return path.join(known, on, "left").withColumn("cover_mark", F.col("__start").isNotNull()).drop(*[f"__{c}" for c in PAIR])


def pair_cover(schema: PathSchema, path: DataFrame, pairs: DataFrame, name: str = "cover_count") -> DataFrame:
    """Distinct pairs with the number of paths that connect them."""
    counts = ends(schema, path).where(F.col("end").isNotNull()).groupBy(*PAIR).agg(F.count("*").alias(name))
    return pairs.select(*PAIR).distinct().join(counts, list(PAIR), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def cover_summary(paths: Mapping[str, tuple[PathSchema, DataFrame]] | Iterable[tuple[PathSchema, DataFrame]], pairs: DataFrame) -> DataFrame:
    """A row per schema: paths, covering paths, pairs, covered pairs and their rates."""
    items = list(paths.values()) if isinstance(paths, Mapping) else list(paths)
    parts = [ends(s, df).groupBy(*PAIR).agg(F.count("*").alias("n")).withColumn("schema", F.lit(s.name)) for s, df in items]
    counts = reduce(lambda a, b: a.unionByName(b), parts)
    known = pairs.select(*PAIR).distinct().withColumn("known", F.lit(1))
    hit = F.col("known").isNotNull()
    agg = counts.join(known, list(PAIR), "left").groupBy("schema").agg(
        F.sum("n").alias("path_count"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("path_cover_count"),
        F.count_if(hit).alias("pair_cover_count"),
    )
    return cover_rates(agg, known)


def cover_rates(sums: DataFrame, known: DataFrame) -> DataFrame:
    """(schema, path_count, path_cover_count, pair_cover_count) with the numbers of ``known`` pairs, what is not covered, and rates."""
    total = known.agg(F.count("*").alias("pair_count"))  # one row
    return sums.join(F.broadcast(total)).select(
        "schema", "path_count", "path_cover_count", (F.col("path_count") - F.col("path_cover_count")).alias("path_uncover_count"), "pair_count", "pair_cover_count",
        (F.col("pair_count") - F.col("pair_cover_count")).alias("pair_uncover_count"),
        F.try_divide("path_cover_count", "path_count").alias("path_cover_rate"), F.try_divide("pair_cover_count", "pair_count").alias("pair_cover_rate"),
    )


def choose_main(summary: DataFrame, max_main: int = 5, min_valid: int = 10, min_main: int = 50, min_rate: float = 1e-4) -> tuple[list[str], list[str]]:
    """(main, auxiliary) schema names: valid ones by descending path cover rate; a row per schema reaches the driver."""
    rows = summary.where(F.col("path_cover_count") > min_valid).select("schema", "path_cover_count", "path_cover_rate").collect()
    rows.sort(key=lambda r: (-r.path_cover_rate, r.schema))
    main = [r.schema for r in rows if r.path_cover_count > min_main and r.path_cover_rate > min_rate][:max_main]
    return main, [r.schema for r in rows if r.schema not in main]


def cover_kinds(paths: Mapping[str, tuple[PathSchema, DataFrame]], names: Iterable[str], pairs: DataFrame) -> DataFrame:
    """Pairs with the number of schemas that connect them and of all connecting paths."""
    known = pairs.select(*PAIR).distinct()
    parts = [ends(*paths[n]).where(F.col("end").isNotNull()).groupBy(*PAIR).agg(F.count("*").alias("n")) for n in names]
    counts = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*PAIR).agg(F.count("*").alias("cover_kinds"), F.sum("n").alias("cover_total"))
    return known.join(counts, list(PAIR), "left").fillna(0, ["cover_kinds", "cover_total"])


def sample_pairs(paths: Mapping[str, tuple[PathSchema, DataFrame]], main: Iterable[str], pairs: DataFrame) -> DataFrame:
    """Labelled samples: pairs that a main path hits are positives; other (start, end) that main
    paths connect, of starts with a hit, are negatives.  What the paths connect is stored, as it is used twice."""
    every = reduce(lambda a, b: a.unionByName(b), [ends(*paths[n]) for n in main]).distinct()
    known = pairs.select(*PAIR).distinct().withColumn("__k", F.lit(1))
    marked = stored(every.join(known, list(PAIR), "left"))
    starts = marked.where(F.col("__k").isNotNull()).select("start", TIME).distinct()
    return marked.join(starts, ["start", TIME], "left_semi").select(*PAIR, F.coalesce("__k", F.lit(0)).alias("Label"))


def label_connected(paths: Iterable[tuple[PathSchema, DataFrame]], pairs: DataFrame) -> DataFrame:
    """Distinct (start, end, month) that any path connects, with ``Label``: whether the pair is known."""
    every = reduce(lambda a, b: a.unionByName(b), [ends(s, df) for s, df in paths]).where(F.col("end").isNotNull()).distinct()
    known = pairs.select(*PAIR).distinct().withColumn("__k", F.lit(1))
    return every.join(known, list(PAIR), "left").select(*PAIR, F.col("__k").isNotNull().alias("Label"))


def label_factored(found: Iterable[Factored], pairs: DataFrame) -> DataFrame:
    """``label_connected`` from the factors of paths, without a shuffle of starts times ends.

    Pairs through a node of many starts and many ends are made last, by tasks that each take a part of the node's starts and lists
    of its ends, and go straight to the result: a pair of a start or an end with one such node occurs there once, and a start carries its
    known ends along.  All other pairs (through nodes of few starts or ends, through several large nodes at both ends, or where nodes
    must differ) are listed, told apart and labelled by one sum of marks.
    """
    key, found = ["__via", "__node", TIME], list(found)
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    apart = [ends(f.schema, f.paths()).where(F.col("end").isNotNull()) for f in found if f.differs is not None]
    factors = [(k, f) for k, f in enumerate(found) if f.differs is None]
    known = stored(pairs.select(*PAIR).dropna().distinct())

    def told(listed: DataFrame, made: DataFrame | None = None, kept: Iterable[DataFrame] = ()) -> DataFrame:
        """Distinct pairs that are listed and not made elsewhere, or kept, with their labels."""
        marks = [(1, listed), (8, known), *[(4, df) for df in kept], *([] if made is None else [(2, made)])]
        m = union([df.select(*PAIR, F.lit(k).alias("__m")) for k, df in marks]).groupBy(*PAIR).agg(F.bit_or("__m").alias("__m"))
        return m.where("__m & 4 <> 0 OR __m & 3 = 1").select(*PAIR, F.expr("__m & 8 <> 0").alias("Label"))

    if not factors:
        return told(union(apart))

    def factor(k: int, f: Factored, df: DataFrame, node: str, name: str, once: bool) -> DataFrame:
        rows = df.select(F.lit(k).alias("__via"), F.col(f.last).cast("string").alias("__node"), TIME, F.col(node).alias(name)).dropna()
        return rows if once else rows.distinct()

    # Parallel edges are one, so a start comes once to a node that lies one hop away, and a node once to an end.
    heads = stored(union([factor(k, f, f.prefix, "Node_0", "start", len(f.schema.edges) <= 2) for k, f in factors]))
    tails = stored(union([factor(k, f, f.edges, f.schema.end, "end", len(f.schema.edges[-1].tails) == 1) for k, f in factors]))
    many = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n)).where(F.col(n) > LIGHT)
    large = stored(many(heads, "__a").join(many(tails, "__b"), key).withColumn("__parts", F.ceil(F.col("__a") * F.col("__b") / TASK_PAIRS)))
    listed = union([heads.join(large, key, "left_anti").join(tails, key).select(*PAIR), *(d.select(*PAIR) for d in apart)])
    total = large.agg(F.sum(F.col("__a").cast("double") * F.col("__b"))).first()[0]  # one row
    if total is None:
        return told(listed)

    # How many large nodes a start and an end have in a month.
    of = large.select(*key, "__b", "__parts")
    heads = stored(heads.join(of, key).drop("__b").withColumn("__n", F.count("*").over(Window.partitionBy("start", TIME))))
    tails = stored(tails.join(of, key).withColumn("__m", F.count("*").over(Window.partitionBy("end", TIME))))
    listed = stored(listed)
    made = listed.join(heads.select(*key, "start"), ["start", TIME]).join(tails.select(*key, "end"), [*key, "end"], "left_semi")
    several = heads.where("__n > 1").join(tails.where("__m > 1"), key)
    tasks = min(TASKS, math.ceil(total / TASK_PAIRS))
    chunk = F.pmod(F.xxhash64("end"), F.ceil(F.col("__b") / CHUNK)).alias("__chunk")
    lists = tails.groupBy(*key, "__parts", (F.col("__m") > 1).alias("__several"), chunk).agg(F.collect_list("end").alias("__ends"))

    def product(heads: DataFrame, *more: str) -> DataFrame:
        a = heads.withColumn("__part", F.pmod(F.xxhash64("start"), F.col("__parts"))).drop("__parts").repartition(tasks, *key, "__part")
        b = lists.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts").repartition(tasks, *key, "__part")
        return a.join(b, [*key, "__part"]).where("__n = 1 OR NOT __several").select("start", F.explode("__ends").alias("end"), TIME, *more)

    much = known.groupBy("start", TIME).agg(F.count("*").alias("__k")).where(F.col("__k") > CARRIED)
    carried = known.join(much, ["start", TIME], "left_anti").groupBy("start", TIME).agg(F.collect_list("end").alias("__known"))
    few = heads.join(much, ["start", TIME], "left_anti").join(carried, ["start", TIME], "left")
    label = F.coalesce(F.array_contains("__known", F.col("end")), F.lit(False))
    rest = told(listed, made, [several, product(heads.join(much, ["start", TIME], "left_semi"))])
    return product(few, "__known").select(*PAIR, label.alias("Label")).unionByName(rest)


def restrict(schema: PathSchema, path: DataFrame, samples: DataFrame) -> DataFrame:
    """Paths between sampled pairs only."""
    keys = samples.select(F.col("start").alias("Node_0"), F.col("end").alias(schema.end), TIME).distinct()
    return path.join(keys, ["Node_0", schema.end, TIME], "left_semi").select(*path.columns)


def split_by_time(samples: DataFrame, starts: DataFrame, ranges: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Samples with the split whose [from, to) holds their start's ``Source_Time``; a start of several times counts for each."""
    timed = samples.join(starts.select("start", TIME, "Source_Time").distinct(), ["start", TIME])
    split = reduce(lambda c, kv: c.when((F.col("Source_Time") >= kv[1][0]) & (F.col("Source_Time") < kv[1][1]), kv[0]), ranges.items(), F)
    return timed.withColumn("split", split).where(F.col("split").isNotNull())
