"""Items of varying length into containers of fixed capacity.

1. An item longer than the capacity gives full containers and a rest; every other item stays whole.
2. One aggregate gives the global histogram of lengths, at most ``capacity`` rows for the driver.
3. Dynamic programming over the histogram chooses the length buckets that minimise padding (the space between an item
   and the upper bound of its bucket).
4. Token-budget batches: a batch takes as many items of a bucket as fit into what the longer buckets left of a
   container.  Batches of one bucket alone leave the rest of the capacity unused (``single_bucket_unused`` measures
   it), so a container's rest is filled with batches of shorter buckets; the plan of such patterns is computed over
   the bucket counts, so its size depends on the number of buckets, not on the data.
5. Items get their rank within their bucket by running totals over hash buckets, and the rank gives container and
   position.  No task sees more than one hash bucket of a length bucket.

Defined results: items of size zero (null or empty texts) take no space and get no container (null, position 0);
repeated rows are items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.prefix import hash_bucket, running_total
from rankloom.session import materialize

#: Most length buckets of one capacity.
BUCKETS = 96
#: Items for each hash bucket of a rank.
ROWS_PER_BUCKET = 50_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct lengths with the least padding.

    The cost of a bucket obeys the quadrangle inequality, so each layer is solved by divide and conquer.
    """
    m = len(lengths)
    if m <= buckets:
        return lengths
    n, total = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    cost = lambda i, j: lengths[j - 1] * (n[j] - n[i]) - (total[j] - total[i])  # noqa: E731  padding of lengths i .. j-1
    best = np.full(m + 1, np.inf)
    best[0] = 0
    choice = np.zeros((buckets + 1, m + 1), np.int32)
    for layer in range(1, buckets + 1):
        now = np.full(m + 1, np.inf)
        now[0] = 0
        stack = [(1, m, 0, m - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            options = np.arange(first, min(last, mid - 1) + 1)
            values = best[options] + cost(options, mid)
            k = int(values.argmin())
            now[mid], choice[layer, mid] = values[k], options[k]
            stack += [(low, mid - 1, first, int(options[k])), (mid + 1, high, int(options[k]), last)]
        best = now
    bounds, at = [], m
    for layer in range(buckets, 0, -1):
        bounds.append(int(lengths[at - 1]))
        at = int(choice[layer, at])
        if at == 0:
            break
    return np.array(bounds[::-1])


@dataclass
class Plan:
    """Where the item of a given rank in a bucket goes: arrays by (bucket, first rank)."""

    capacity: int
    bounds: np.ndarray
    bucket: np.ndarray
    first: np.ndarray
    each: np.ndarray
    container: np.ndarray
    position: np.ndarray
    containers: int
    patterns: int

    def place(self, bucket: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(container, position) for arrays of buckets and ranks (from 0)."""
        width = np.int64(1) << np.int64(44)
        row = np.searchsorted(self.bucket.astype(np.int64) * width + self.first, bucket.astype(np.int64) * width + rank, side="right") - 1
        inside = rank - self.first[row]
        return self.container[row] + inside // self.each[row], self.position[row] + inside % self.each[row] + 1


def make_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> Plan:
    bounds = optimal_bounds(lengths, counts, buckets)
    owner = np.searchsorted(bounds, lengths, side="left")
    left = np.bincount(owner, counts, len(bounds)).astype(np.int64)
    used = np.zeros(len(bounds), np.int64)
    rows, container, patterns = [], 0, 0
    while left.any():
        room, taken, position = capacity, [], 0
        for b in range(len(bounds) - 1, -1, -1):
            k = min(int(left[b]), room // int(bounds[b]))
            if k:
                taken.append((b, k, position))
                room -= k * int(bounds[b])
                position += k
        times = min(int(left[b]) // k for b, k, _ in taken)
        for b, k, position in taken:
            rows.append((b, int(used[b]), k, container, position))
            used[b] += times * k
            left[b] -= times * k
        container += times
        patterns += 1
    rows.sort()
    columns = [np.array(x, np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(capacity, bounds, *columns, containers=container, patterns=patterns)


def single_bucket_unused(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> float:
    """The unused share if every container held items of one bucket only."""
    bounds = optimal_bounds(lengths, counts, buckets)
    left = np.bincount(np.searchsorted(bounds, lengths, side="left"), counts, len(bounds))
    containers = np.ceil(left / (capacity // bounds)).sum()
    return float(1 - (lengths * counts).sum() / (containers * capacity)) if containers else 0.0


def histogram(items: DataFrame, capacities: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted lengths with counts for each capacity; at most ``capacity`` rows each come to the driver."""
    rows = items.filter("size BETWEEN 1 AND capacity").groupBy("capacity", "size").agg(F.count("*").alias("n")).orderBy("capacity", "size").collect()
    return {c: (np.array([r["size"] for r in rows if r["capacity"] == c], np.int64), np.array([r["n"] for r in rows if r["capacity"] == c], np.int64)) for c in capacities}


def pack(sizes: DataFrame, key: str, size: str, capacities: list[int], buckets: int = BUCKETS) -> tuple[DataFrame, dict[int, Plan]]:
    """((capacity, key, piece, token_start, tokens, container_id, position), plans) for a materialised table of sizes."""
    each = sizes.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n"), F.explode(F.array(*[F.lit(c) for c in capacities])).alias("capacity"))
    each = each.withColumn("full", F.floor(F.col("n") / F.col("capacity")).cast("bigint")).withColumn("full", F.when(F.col("n") == F.col("capacity"), F.lit(0)).otherwise(F.col("full")))
    items = each.withColumn("size", F.col("n") - F.col("full") * F.col("capacity"))
    hist = histogram(items, capacities)
    plans = {c: make_plan(*hist[c], c, buckets) for c in capacities}
    number = max(8, int(sizes.count() / ROWS_PER_BUCKET))
    bucket = F.lit(None).cast("int")
    for c, plan in plans.items():
        bounds = plan.bounds.tolist()
        if bounds:
            bucket = F.when(F.col("capacity") == c, _bucket_of(F.col("size"), bounds)).otherwise(bucket)
    ranked = items.filter("size > 0").withColumn("bucket", bucket).withColumn("hb", hash_bucket(number, 23, F.col("key")))
    totals = ranked.groupBy("capacity", "bucket", "hb").agg(F.count("*").alias("c"))
    before = W.partitionBy("capacity", "bucket").orderBy("hb").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("capacity", "bucket", "hb", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("capacity", "bucket", "hb").orderBy(F.xxhash64(F.lit(29), "key"), "key")
    ranked = ranked.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["capacity", "bucket", "hb"])
    ranked = ranked.select("capacity", "key", "full", "size", "bucket", (F.col("before") + F.col("rank")).alias("rank"))
    key_type = dict(sizes.dtypes)[key]
    out = f"capacity int, key {key_type}, piece bigint, token_start bigint, tokens bigint, container_id bigint, position bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capacity, full, length, bucket_no, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("capacity", "full", "size", "bucket", "rank"))
            container, position = np.zeros(len(capacity), np.int64), np.zeros(len(capacity), np.int64)
            for c, plan in plans.items():
                own = capacity == c
                if own.any():
                    container[own], position[own] = plan.place(bucket_no[own], rank[own])
            yield pa.RecordBatch.from_arrays([batch["capacity"], batch["key"], pa.array(full), pa.array(full * capacity), pa.array(length), pa.array(container), pa.array(position)], ["capacity", "key", "piece", "token_start", "tokens", "container_id", "position"])

    placed = ranked.mapInArrow(run, out)
    # Full pieces of long items have containers of their own, numbered after the planned ones.
    long = each.filter("full > 0").withColumn("hb", hash_bucket(number, 23, F.col("key")))
    numbered = running_total(long, ["capacity"], "hb", [F.xxhash64(F.lit(29), "key"), F.col("key")], "full", "first")
    base = F.lit(0).cast("bigint")
    for c, plan in plans.items():
        base = F.when(F.col("capacity") == c, F.lit(plan.containers).cast("bigint")).otherwise(base)
    pieces = numbered.select("capacity", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"), (base + F.col("first")).alias("base"))
    pieces = pieces.select("capacity", "key", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").cast("bigint").alias("tokens"), (F.col("base") + F.col("piece")).alias("container_id"), F.lit(1).cast("bigint").alias("position"))
    nothing = F.lit(0).cast("bigint")
    empty = each.filter("n = 0").select("capacity", "key", nothing.alias("piece"), nothing.alias("token_start"), nothing.alias("tokens"), F.lit(None).cast("bigint").alias("container_id"), nothing.alias("position"))
    return placed.unionByName(pieces).unionByName(empty).withColumnRenamed("key", key), plans


def _bucket_of(size, bounds: list[int]):
    """The number of the bucket: how many bounds lie below the size."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < size))


def pack_texts(df: DataFrame, key: str, text: str, capacities: list[int], vocabulary: str, buckets: int = BUCKETS) -> tuple[DataFrame, dict[int, Plan]]:
    from rankloom.llm.tokens import token_counts

    return pack(materialize(token_counts(df, key, text, vocabulary=vocabulary)), key, "tokens", capacities, buckets)
