"""Scorers as Arrow UDFs, external converters and review requests."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scorer(Protocol):
    """Gives each text of a batch a number; loaded once for each Python worker."""

    def __call__(self, texts: list[str]) -> list[float]: ...


def overlap_scorer() -> Scorer:
    """A deterministic scorer for tests: shared characters of context and candidate, shorter candidates first."""

    def score(texts: list[str]) -> list[float]:
        out = []
        for text in texts:
            parts = text.split(" [SEP] ")
            out.append(len(set(parts[-1]) & set(parts[0])) - len(parts[-1]) / 100)
        return out

    return score


def score_udf(load: Callable[[], Scorer]):
    """A column function from arrays of pair texts to arrays of scores; texts of one batch are scored together."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for groups in batches:
            flat = [text for group in groups if group is not None for text in group]
            scores, at, out = scorer(flat), 0, []
            for group in groups:
                n = 0 if group is None else len(group)
                out.append(None if group is None else list(map(float, scores[at : at + n])))
                at += n
            yield pd.Series(out)

    return score


def pair_texts(reading: Column, context: Column, candidates: Column) -> Column:
    """The pair text of every candidate of a group."""
    none = F.lit("")
    ctx = F.when(F.coalesce(context, none) != "", F.concat(F.lit("文脈: "), context))
    return F.transform(candidates, lambda c: F.concat_ws(" [SEP] ", F.concat(F.lit("読み: "), F.coalesce(reading, none)), ctx, F.concat(F.lit("候補: "), F.coalesce(c, none))))


def convert_external(keys: DataFrame, column: str, command: list[str]) -> DataFrame:
    """(key, candidates) from an external program that reads keys and writes tab-separated lines; one process a partition.

    The keys should be distinct.  A failing program fails the task with the command and its messages.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = subprocess.run(command, input="\n".join(frame[column]) + "\n", capture_output=True, text=True, encoding="utf-8")
            if done.returncode:
                raise RuntimeError(f"{' '.join(command)} ended with {done.returncode}: {done.stderr[-500:]}")
            rows = [line.split("\t") for line in done.stdout.splitlines() if line]
            yield pd.DataFrame({"key": [r[0] for r in rows], "candidates": [r[1:] for r in rows]})

    return keys.select(column).mapInPandas(run, "key string, candidates array<string>")


def review_request(surface: Column, reading: Column, candidates: Column, context: Column) -> Column:
    """The JSON body of a review: at most twenty candidates and the last five context items."""
    last = F.slice(context, F.greatest(F.size(context) - 4, F.lit(1)), F.lit(5))
    return F.to_json(F.struct(surface.alias("surface"), reading.alias("reading"), F.slice(candidates, 1, 20).alias("candidates"), last.alias("context")))


def parse_verdict(text: str) -> dict:
    """The JSON object of an answer that may be fenced; decision, confidence and reason_code with defaults."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    try:
        found = json.loads(body)
    except ValueError:
        return {"decision": "invalid", "confidence": 0.0, "reason_code": "unparsable"}
    if not isinstance(found, dict):
        return {"decision": "invalid", "confidence": 0.0, "reason_code": "no_object"}
    return {"decision": str(found.get("decision", "invalid")), "confidence": float(found.get("confidence", 0.0)), "reason_code": str(found.get("reason_code", ""))}
