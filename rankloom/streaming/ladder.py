"""The degrade ladder: consecutive timeouts move a client up a tier, consecutive successes down.

Batch: each block of a client's ordered outcomes becomes a table from the state before it to the state after it, and the
tables of a client are followed one after the other, so that no task holds all outcomes of a client.  Stream: the same
step with the state kept by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.prefix import running_total

STEP, TOP = 5, 4  # fixed values: outcomes in a row to move, highest tier


def step(tier: int, bad: int, good: int, timeout: bool) -> tuple[int, int, int]:
    """The next (tier, timeouts in a row, successes in a row)."""
    bad, good = (bad + 1, 0) if timeout else (0, good + 1)
    if bad >= STEP and tier < TOP:
        return tier + 1, 0, good
    if good >= STEP and tier > 0:
        return tier - 1, bad, 0
    return tier, bad, good


def fold(outcomes: Column) -> Column:
    """struct(tier, bad, good) after an ordered array of timeout flags."""
    start = F.struct(F.lit(0).alias("tier"), F.lit(0).alias("bad"), F.lit(0).alias("good"))

    def merge(state: Column, timeout: Column) -> Column:
        bad = F.when(timeout, state["bad"] + 1).otherwise(F.lit(0))
        good = F.when(timeout, F.lit(0)).otherwise(state["good"] + 1)
        up, down = (bad >= STEP) & (state["tier"] < TOP), (good >= STEP) & (state["tier"] > 0)
        return F.struct(
            (state["tier"] + F.when(up, 1).when(down, -1).otherwise(0)).alias("tier"), F.when(up, F.lit(0)).otherwise(bad).alias("bad"), F.when(~up & down, F.lit(0)).otherwise(good).alias("good")
        )

    return F.reduce(outcomes, start, merge)


def limits(tier: Column, candidates: Column, context: Column) -> list[Column]:
    """What a tier allows: candidates, context characters, and whether scoring is off."""
    return [
        F.when(tier >= 1, F.least(candidates, F.lit(15))).otherwise(candidates).alias("cand_cap"),
        F.when(tier >= 3, F.lit(0)).when(tier >= 2, F.lit(20)).otherwise(context).alias("context_chars"), (tier >= 4).alias("off"),
    ]


#: States are tier x WIDTH + (timeouts in a row, else STEP + successes in a row); counts beyond STEP change nothing.
WIDTH = 2 * STEP + 1


def _number(tier: int, bad: int, good: int) -> int:
    return tier * WIDTH + (STEP + min(good, STEP) if good else min(bad, STEP))


def _state(number: int) -> tuple[int, int, int]:
    tier, rest = divmod(number, WIDTH)
    return (tier, rest, 0) if rest <= STEP else (tier, 0, rest - STEP)


MOVES = np.array([[_number(*step(*_state(i), flag)) for i in range((TOP + 1) * WIDTH)] for flag in (False, True)], np.int16)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _passage(blocks: pd.Series) -> pd.Series:
    """The state after a block of outcomes for every state before it."""

    def one(outcomes: np.ndarray) -> np.ndarray:
        states = np.arange(MOVES.shape[1], dtype=np.int16)
        for flag in np.asarray(outcomes, np.int8).tolist():
            states = MOVES[flag][states]
        return states.astype(np.int32)

    return blocks.map(one)


def tiers(df: DataFrame, client: str, order: list[str], timeout: Column, coarse: Column, block: int = 4096) -> DataFrame:
    """(client, tier, bad, good) after all of a client's outcomes; counts stop at STEP.

    ``coarse`` is a whole number that grows with the order, such as the hour; it bounds what one task sorts.  A null
    outcome is a success.
    """
    rows = df.select(client, *order, F.coalesce(timeout, F.lit(False)).alias("_t"), coarse.alias("_coarse"), F.lit(1).alias("_one"))
    placed = running_total(rows, [client], "_coarse", [F.col(c) for c in order], "_one", "_place")
    blocks = placed.groupBy(client, F.floor(F.col("_place") / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_place", "_t"))).alias("_x"))
    passed = blocks.select(client, "_b", _passage(F.transform("_x", lambda x: x["_t"])).alias("_p"))
    chain = F.array_sort(F.collect_list(F.struct("_b", "_p")))
    last = passed.groupBy(client).agg(F.reduce(chain, F.lit(0), lambda state, x: F.get(x["_p"], state)).alias("s"))
    rest = F.col("s") % WIDTH
    return last.select(client, F.floor(F.col("s") / WIDTH).cast("int").alias("tier"), F.when(rest <= STEP, rest).otherwise(0).cast("int").alias("bad"), F.when(rest > STEP, rest - STEP).otherwise(0).cast("int").alias("good"))


STATE = T.StructType([T.StructField("tier", T.IntegerType()), T.StructField("bad", T.IntegerType()), T.StructField("good", T.IntegerType())])


def tier_stream(events: DataFrame, client: str, order: str) -> DataFrame:
    """(client, tier) after each micro-batch; ``events`` has a boolean column ``timeout``.

    The state of a client is three numbers.
    """
    kind = events.schema[client].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tier, bad, good = state.get if state.exists else (0, 0, 0)
        rows = pd.concat([batch[[order, "timeout"]] for batch in batches]).sort_values(order)
        for timeout in rows["timeout"].fillna(False).tolist():
            tier, bad, good = step(tier, bad, good, timeout)
        state.update((tier, bad, good))
        yield pd.DataFrame({client: [key[0]], "tier": [tier]})

    return events.groupBy(client).applyInPandasWithState(update, f"{client} {kind}, tier int", STATE.simpleString().removeprefix("struct<").removesuffix(">"), "update", "NoTimeout")
