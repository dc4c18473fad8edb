"""Training and evaluation sets from annotated rows: sizes come from counts, membership from hash order.

Rows have (row_id, split, sensitive, hit, context); every choice is by place in an order that a hash of the row decides,
so it is the same on every run, and places are running totals over hash buckets, never a window over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.dedup import hash_rank
from rankloom.operators.places import with_place
from rankloom.operators.skew import salted_lookup
from rankloom.session import materialize


@dataclass(frozen=True)
class Sizes:
    """What sets should come to: shares, rows of each evaluation set and least numbers of context-sensitive rows."""

    share: float = 0.35
    lowest: float = 0.30
    highest: float = 0.40
    corrupt: float = 0.02
    train_share: float = 0.8
    evaluation: int = 300
    least_train: int = 100
    least_evaluation: int = 100


def document_split(rows: DataFrame, row: str, document: str, source: str, share: float, seed: int) -> DataFrame:
    """(document, split): documents of fresh sources apart, a share of the others for training, half of the rest unseen, the other half unused.

    A row without a document is one of its own; the source of a document is that of its first row.
    """
    firsts = rows.groupBy(document).agg(F.min_by(F.coalesce(F.col(source), F.lit("")), row).alias("_source")).select(document, F.col("_source").startswith("news_fresh").alias("_fresh"))
    firsts = materialize(firsts)
    pool = firsts.filter("NOT _fresh").select(document)
    n = pool.count()
    t = max(1, int(n * share))
    unseen = max(1, (n - t) // 2) if n > t else 0
    rank = F.col("hash_rank")
    placed = hash_rank(pool, [], document, seed).select(document, F.when(rank < t, "train").when(rank < t + unseen, "unseen").otherwise("unused").alias("split"))
    return placed.unionByName(firsts.filter("_fresh").select(document, F.lit("fresh").alias("split")))


def preferred(rows: DataFrame, row: str, first: str, seed: int, out: str = "place") -> DataFrame:
    """Rows with their place in the order (those with the flag first, hash)."""
    ahead = rows.filter(first).count()
    return hash_rank(rows, [first], row, seed).withColumn(out, F.col("hash_rank") + F.when(F.col(first), 0).otherwise(ahead)).drop("hash_rank")


def train_set(rows: DataFrame, row: str, sizes: Sizes, reserve: int) -> tuple[DataFrame, DataFrame]:
    """((row, role, corrupted) of the training set, (row, role) of the set of seen documents).

    A reserve of sensitive rows is kept for evaluation as long as ``least_train`` stay; anchors, hits first, are as many
    as bring the sensitive rows to their share; a small part of the unused anchors with a context is added corrupted; the
    seen set is the reserve and the next anchors.
    """
    sensitive = materialize(hash_rank(rows.filter("sensitive").select(row), [], row, 31))
    total = sensitive.count()
    kept = reserve if total - reserve >= sizes.least_train else max(0, total - sizes.least_train)
    n = total - kept
    wanted = max(0, min(max(round(n / sizes.share), ceil(n / sizes.highest)), floor(n / sizes.lowest)) - n) if n else 0
    anchors = materialize(preferred(rows.filter("NOT sensitive").select(row, "hit", "context"), row, "hit", 32))
    role = lambda df, name: df.select(row, F.lit(name).alias("role"))
    chosen = role(sensitive.filter(F.col("hash_rank") >= kept), "sensitive").unionByName(role(anchors.filter(F.col("place") < wanted), "anchor"))
    count = n + min(wanted, anchors.count())
    unused = anchors.filter(F.col("place") >= wanted)
    spoiled = hash_rank(unused.filter("context").select(row), [], row, 33).filter(F.col("hash_rank") < round(count * sizes.corrupt)).select(row)
    spoiled = materialize(spoiled)
    train = chosen.withColumn("corrupted", F.lit(False)).unionByName(role(spoiled, "anchor").withColumn("corrupted", F.lit(True)))
    left = preferred(unused.select(row, "hit").join(spoiled, row, "left_anti"), row, "hit", 34)
    seen = role(sensitive.filter(F.col("hash_rank") < kept), "sensitive").unionByName(role(left.filter(F.col("place") < max(0, sizes.evaluation - kept)), "anchor"))
    return train, seen


def evaluation_set(rows: DataFrame, row: str, sizes: Sizes, seed: int) -> DataFrame:
    """(row, role): sensitive rows up to their share, anchors with hits first, and what is left where either falls short.

    With fewer sensitive rows than ``least_evaluation`` all of them are taken, and the set grows if they would be more
    than the highest share of it.
    """
    sensitive = materialize(hash_rank(rows.filter("sensitive").select(row), [], row, seed))
    have, n = sensitive.count(), sizes.evaluation
    taken = min(have, max(sizes.least_evaluation, round(n * sizes.share)))
    if have < sizes.least_evaluation:
        taken = have
        n = ceil(have / sizes.share) if have and have / max(n, 1) > sizes.highest else n
    anchors = materialize(preferred(rows.filter("NOT sensitive").select(row, "hit"), row, "hit", seed + 1))
    wanted = max(0, n - taken)
    first = sensitive.filter(F.col("hash_rank") < taken).select(row, F.lit("sensitive").alias("role")).unionByName(anchors.filter(F.col("place") < wanted).select(row, F.lit("anchor").alias("role")))
    short = n - taken - min(wanted, anchors.count())
    if short <= 0:
        return first
    rest = sensitive.filter(F.col("hash_rank") >= taken).filter(F.col("hash_rank") < taken + short)
    return first.unionByName(rest.select(row, F.lit("fill").alias("role")))


def cycled(df: DataFrame, key: str, order: str, total: int, seed: int) -> DataFrame:
    """(round, key, order): rounds over the keys, each giving its next row and starting again after its last, until ``total`` rows.

    Every round but the last has a row of each key, so the rounds of a row follow from its place; the last round takes
    the keys that come first in hash order.
    """
    keys = df.select(key).distinct()
    number = keys.count()
    if not number or total <= 0:
        return df.select(F.lit(0).alias("round"), key, order).limit(0)
    whole, rest = divmod(total, number)
    last = hash_rank(keys, [], key, seed).filter(F.col("hash_rank") < rest).select(key, F.lit(True).alias("_last"))
    rows = salted_lookup(with_place(df, key, order), last, [key], [F.col(order)], "left")
    most = whole + F.when(F.col("_last"), 1).otherwise(0)
    rounds = F.when(F.col("place") < most, F.sequence(F.col("place"), (most - 1).cast("bigint"), F.col("n")))
    return rows.select(F.explode(rounds).alias("round"), key, order).withColumn("round", F.col("round").cast("int"))


def anchored_sample(rows: DataFrame, row: str, anchor: str, total: int, share: float, seed: int) -> DataFrame:
    """(row, role): a share of anchors, others up to the total, and whatever is left where either falls short."""
    ranked = materialize(hash_rank(rows.select(row, anchor), [anchor], row, seed))
    have = {r[anchor]: r["n"] for r in ranked.groupBy(anchor).agg(F.count("*").alias("n")).collect()}  # at most two rows
    first = min(have.get(True, 0), round(total * share))
    second = min(have.get(False, 0), max(0, total - first))
    quota = F.when(F.col(anchor), first).otherwise(second)
    chosen = ranked.filter(F.col("hash_rank") < quota).select(row, F.when(F.col(anchor), "anchor").otherwise("residual").alias("role"))
    short = total - first - second
    if short <= 0:
        return chosen
    left = hash_rank(ranked.filter(F.col("hash_rank") >= quota).select(row), [], row, seed + 1).filter(F.col("hash_rank") < short)
    return chosen.unionByName(left.select(row, F.lit("fill").alias("role")))
