import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import packing, tokens


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 60), 9)))
        counts = np.array([rng.randint(1, 9) for _ in lengths])

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(padding([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
        assert padding(packing.optimal_bounds(lengths, counts, 3)) == best


def first_fit(sizes, capacity):
    """Containers of first-fit decreasing on one machine."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity - n)
        else:
            rooms[at] -= n
    return len(rooms)


def packed(spark, sizes, capacities, buckets=16):
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n bigint").withColumn("bucket", F.lit(0)).withColumn("hb", F.lit(0))
    return [r.asDict() for r in packing.pack(df, "id", "n", capacities, buckets)[0].collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_invariants(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 64, 65, 128, 200, rng.randint(1, 60)]) for _ in range(600)]
    rows = packed(spark, sizes, [64, 128])
    for capacity in (64, 128):
        own = [r for r in rows if r["capacity"] == capacity]
        held, spans = {}, {}
        for r in own:
            spans.setdefault(r["id"], []).append((r["token_start"], r["tokens"]))
            if r["container_id"] is not None:
                held.setdefault(r["container_id"], []).append(r)
        for i, n in enumerate(sizes):
            pieces = sorted(spans[i])
            assert sum(t for _, t in pieces) == n
            assert len(pieces) == max(1, -(-n // capacity))
            assert all(a + t == b for (a, t), (b, _) in itertools.pairwise(pieces))
        assert sorted(held) == list(range(len(held)))
        assert all(sum(r["tokens"] for r in x) <= capacity and sorted(r["position"] for r in x) == list(range(1, len(x) + 1)) for x in held.values())
        assert len(held) <= 1.04 * first_fit([t for i in spans for _, t in spans[i] if t], capacity)


def test_defined_cases(spark):
    assert packed(spark, [], [64]) == []
    assert [(r["container_id"], r["position"]) for r in packed(spark, [0], [64])] == [(None, 0)]
    assert len(packed(spark, [64] * 10, [64])) == 10
    assert [r["tokens"] for r in sorted(packed(spark, [130], [64]), key=lambda r: r["piece"])] == [64, 64, 2]
    hot = packed(spark, [40] * 3000 + [20] * 3000, [60])
    assert len({r["container_id"] for r in hot}) == 3000


def test_token_counts(spark):
    rows = [(1, "漢字かな"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "長い" * 40_000), (5, "again")]
    got = tokens.token_counts(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    assert sorted(tuple(r) for r in got) == sorted((i, len(encode(t)) if t else 0) for i, t in rows)
