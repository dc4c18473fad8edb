"""Groups of rows that belong together, by frontier breadth-first search, and splits that keep groups whole.

The graph is bipartite: sources on one side, readings on the other, one edge for each distinct pair.  One level:

* seeds are the sources with the smallest id among all sources within two hops, so every group has a seed and two
  seeds never share a reading;
* all seeds expand at once: the frontier (source, seed) is joined with the edges, hash-partitioned by source and then
  by reading, the smallest seed wins a source, and newly reached sources are the next frontier;
* where seeds collide (a reading that two seeds' regions share) the regions belong together.  The graph of seeds and
  the readings they share is the next level's graph, at most half as large; once it has few enough edges (``SMALL``,
  checked) it is merged by union-find in one task, else the level repeats on it.

Nothing of all rows reaches the driver, only counts, and no table that grows with the rows is broadcast: the joins are
hinted to merge.  What a level has replaced is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.prefix import buckets_for, hash_bucket, running_total
from rankloom.operators.skew import salted_lookup
from rankloom.session import discard, materialize

#: Most edges of a seed graph that one task merges.
SMALL = 400_000
#: Rounds after which the tables of a search are written as one.
ROUNDS = 8
#: A group of this share of all rows or more is placed before the others.
LARGE_GROUP = 0.01


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    return salted_lookup(rows, table, keys, [F.col(spread)], how, null_safe=null_safe, hint="merge")


def shared_only(edges: DataFrame) -> DataFrame:
    """The edges of readings with two or more sources; the others link nothing."""
    shared = edges.groupBy("r").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo <> hi").select("r")
    return _lookup(edges, shared, ["r"], "s", "left_semi")


def find_seeds(edges: DataFrame) -> DataFrame:
    """(s, label): the sources that are the smallest within two hops."""
    low = edges.groupBy("r").agg(F.min("s").alias("m"))
    near = _lookup(edges, low, ["r"], "s").groupBy("s").agg(F.min("m").alias("m"))
    return near.filter("m = s").select("s", F.col("s").alias("label"))


def expand(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(s, label): every source with the seed whose search reached it first, the smallest of those of one round.

    Each round writes its new sources only; the rounds are written as one table now and then, and at the end.
    """
    frontier = materialize(seeds)
    rounds = [frontier]
    total = edges.select("s").distinct().count()
    reached = frontier.count()
    while reached < total:
        readings = _lookup(edges, frontier, ["s"], "r").groupBy("r").agg(F.min("label").alias("label"))
        sources = _lookup(edges, readings, ["r"], "s").groupBy("s").agg(F.min("label").alias("label"))
        visited = reduce(DataFrame.unionByName, rounds)
        frontier = materialize(sources.join(visited.select("s").hint("merge"), "s", "left_anti"))
        found = frontier.count()
        if not found:
            break
        reached += found
        rounds.append(frontier)
        if len(rounds) > ROUNDS:
            rounds = [_as_one(rounds[:-1]), frontier]
    return _as_one(rounds) if len(rounds) > 1 else frontier


def _as_one(tables: list[DataFrame]) -> DataFrame:
    whole = materialize(reduce(DataFrame.unionByName, tables))
    for table in tables:
        discard(table)
    return whole


def merge_small(edges: DataFrame) -> DataFrame:
    """(s, label): union-find over a graph that was checked to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        first: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for s, r in zip(batch["s"].to_pylist(), batch["r"].to_pylist(), strict=True):
                a, b = root(s), root(first.setdefault(r, s))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["s", "label"])

    return edges.select("s", "r").coalesce(1).mapInArrow(run, "s bigint, label bigint")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(s, root) for every source of ``edges(s, r)``; sources that share nothing are their own root."""
    current = materialize(shared_only(edges))
    maps = []
    size = current.count()
    while size:
        if size <= small and maps:
            maps.append(materialize(merge_small(current)))
            break
        labels = expand(current, find_seeds(current))
        maps.append(labels)
        merged = _lookup(current, labels, ["s"], "r").select(F.col("label").alias("s"), "r").distinct()
        before, current = current, materialize(shared_only(merged))
        discard(before)
        size = current.count()
    roots = edges.select("s").distinct().withColumn("root", F.col("s"))
    for labels in maps:
        named = labels.select(F.col("s").alias("root"), "label")
        roots = _lookup(roots, named, ["root"], "s", "left").select("s", F.coalesce("label", "root").alias("root"))
    whole = materialize(roots)
    for table in [current, *maps]:
        discard(table)
    return whole


def keyed_pairs(df: DataFrame, source: str, reading: str, source_norm, reading_norm) -> DataFrame:
    """(source, reading, n, source_key, reading_key, s, r): the distinct raw pairs with their norms and ids.

    Ids are 64-bit hashes; whether two keys share one is checked, and another hash seed is taken until none do.
    """
    raw = df.groupBy(F.col(source).alias("source"), F.col(reading).alias("reading")).agg(F.count("*").alias("n"))
    normed = materialize(raw.withColumn("source_key", source_norm(F.col("source"))).withColumn("reading_key", reading_norm(F.col("reading"))))
    for seed in range(1, 64):
        pairs = normed.withColumn("s", F.when(F.col("source_key").isNotNull(), F.xxhash64(F.lit(seed), "source_key"))).withColumn("r", F.when(F.col("reading_key").isNotNull(), F.xxhash64(F.lit(-seed), "reading_key")))
        keys = pairs.select(F.lit(0).alias("side"), F.col("s").alias("id"), F.col("source_key").alias("key")).unionByName(pairs.select(F.lit(1).alias("side"), F.col("r").alias("id"), F.col("reading_key").alias("key")))
        if keys.filter("id IS NOT NULL").groupBy("side", "id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").isEmpty():
            return pairs
    raise RuntimeError("no hash without collisions was found")


def edges_of(pairs: DataFrame) -> DataFrame:
    return pairs.filter("s IS NOT NULL AND r IS NOT NULL").select("s", "r").distinct()


def source_groups(pairs: DataFrame) -> DataFrame:
    """(source_key, group_key) for the groups of two or more sources; group_key is the smallest of the group."""
    sources = pairs.filter("s IS NOT NULL").groupBy("s").agg(F.min("source_key").alias("source_key"))
    rooted = materialize(sources.join(components(edges_of(pairs)).hint("merge"), "s").select("source_key", "root"))
    groups = rooted.groupBy("root").agg(F.min("source_key").alias("group_key"), F.max("source_key").alias("_last")).filter("group_key <> _last").select("root", "group_key")
    return _lookup(rooted, groups, ["root"], "source_key").select("source_key", "group_key")


def split_rows(df: DataFrame, pairs: DataFrame, key: str, source: str, reading: str, shares: dict[str, float], seed: int = 11) -> DataFrame:
    """(key, component, split): all rows of a group in one split, near the given shares.

    Groups of ``LARGE_GROUP`` of the rows or more (at most 1 / LARGE_GROUP of them) are placed first, largest first,
    where most room is left; the others follow in hash order, by the middle of their interval of running row counts.
    The rows of a source without any reading are one group; a row with neither source nor reading is a group of its own.
    """
    roots = components(edges_of(pairs))
    by_reading = pairs.filter("r IS NOT NULL AND s IS NOT NULL").select("s", "r").distinct().join(roots.hint("merge"), "s").groupBy("r").agg(F.min("root").alias("reading_root"))
    known = pairs.join(roots.hint("merge"), "s", "left").join(by_reading.hint("merge"), "r", "left").select("source", "reading", "n", F.coalesce("root", "reading_root", "s", "r").alias("component"))
    known = materialize(known)
    lone = df.filter(F.col(source).isNull() & F.col(reading).isNull())
    sizes = known.filter("component IS NOT NULL").groupBy("component").agg(F.sum("n").alias("n")).unionByName(lone.select(F.xxhash64(F.lit("row"), key).alias("component"), F.lit(1).cast("bigint").alias("n"))).groupBy("component").agg(F.sum("n").alias("n"))
    sizes = materialize(sizes)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(2, int(total * LARGE_GROUP))
    room = {name: share * total / sum(shares.values()) for name, share in shares.items()}
    placed = []
    for row in sizes.filter(F.col("n") >= limit).orderBy(F.desc("n"), "component").collect():  # at most 1 / LARGE_GROUP rows
        name = max(room, key=lambda x: (room[x], x))
        room[name] -= row["n"]
        placed.append((row["component"], name))
    rest = sizes.filter(F.col("n") < limit)
    rest = rest.withColumn("_bucket", hash_bucket(buckets_for(rest.count()), seed, F.col("component"))).withColumn("_h", F.xxhash64(F.lit(seed), "component"))
    ranked = running_total(rest, [], "_bucket", [F.col("_h"), F.col("component")], "n", "_start")
    open_room = {name: max(0.0, x) for name, x in room.items()}
    scale = sum(open_room.values()) or 1.0
    left_rows = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    middle, bound, split = F.col("_start") + F.col("n") / 2, 0.0, F.lit(None).cast("string")
    names = list(open_room)
    for name in names:
        bound += open_room[name] / scale * left_rows
        split = F.coalesce(split, F.when(middle < bound, F.lit(name)))
    chosen = ranked.select("component", F.coalesce(split, F.lit(names[-1])).alias("split"))
    if placed:
        chosen = chosen.unionByName(df.sparkSession.createDataFrame(placed, "component bigint, split string"))
    chosen = materialize(chosen)
    lookup = known.select("source", "reading", "component")
    rows = df.select(key, F.col(source).alias("source"), F.col(reading).alias("reading"))
    named = _lookup(rows, lookup, ["source", "reading"], key, "left", null_safe=True)
    named = named.select(key, F.coalesce("component", F.xxhash64(F.lit("row"), key)).alias("component"))
    return _lookup(named, chosen, ["component"], key, "left").select(key, "component", "split")
