"""Mixing sources to target weights by soft-membership least squares.

1. A classifier of domains (softmax regression over hashed character pairs) is trained on a labelled sample of at most
   ``SAMPLE`` documents of each source, however many sources there are; it predicts the posterior of every document.
2. A document's membership in the domains of a mix is that posterior over them, so ambiguous documents count for several.
3. Rates (expected repeats) of all documents are fitted by projected gradient: the residual between expected domain
   token totals and targets is summed over all documents in each step, and each rate moves against it and is projected
   to [0, max_repeats], until no domain of a mix is off by more than ``RESIDUAL`` of the mix, or for ``STEPS`` steps.
   Rates are a function of the few residual vectors so far, so nothing is stored between steps.
4. The task counts shares by the sources' own names, so the rates of each source are then brought to its target by that
   count, down in proportion or up by a part of what each lacks to its repeats; ``Mixed.fit`` holds both totals.  Rates
   become whole repeats by systematic rounding over running totals in length order, which is the same at every size.
5. What the rounding leaves over or short in a source is settled by rounding single documents the other way.

No length is left out: every document with text of a source of the mix takes part in the fit.

The total is the largest for which every present source can meet its share within its repeats.  Sources of a mix that
have no tokens are left out, the other weights are rescaled, and the report shows them with share zero.

Defined results: null and empty texts and documents of other or null sources are not chosen; repeated rows count each;
weights need not add up to one; an empty table or no targets give an empty mix.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.tokens import VOCABULARY, encoding
from rankloom.operators.dedup import cap_per_key
from rankloom.operators.prefix import buckets_for, running_total
from rankloom.session import discard, materialize

#: Width of the hashed features; labelled documents of each source, and how many come to the driver at once.
WIDTH, SAMPLE, ROWS_AT_ONCE = 1024, 100, 1024
#: Rows whose scores are held at once, in training and in judging; most sources for which they are that many.
TRAINED, JUDGED, MOST_SOURCES = 4096, 512, 2000
#: Gradient steps at most, and the residual of a domain, as a part of its mix, at which they end.
STEPS, RESIDUAL = 12, 0.002
#: Posteriors below this are left out, the others make up one.
LEAST = 0.002
#: Documents of each length class of a source that may be rounded the other way.
SETTLE = 16


def hashed_pairs(texts: list[str | None]) -> np.ndarray:
    """(texts, WIDTH): log counts of hashed character pairs of whole texts, of length one."""
    joined = "\n".join(x or "" for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(x or "") + 1 for x in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    pair = (codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) ^ codes[1:].astype(np.uint64) * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(54)
    same = owner[:-1] == owner[1:]
    counts = np.bincount(owner[:-1][same] * WIDTH + pair[same].astype(np.int64), minlength=len(texts) * WIDTH)
    rows = np.log1p(counts.reshape(len(texts), WIDTH).astype(np.float32))
    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-6)


def rows_at_once(rows: int, classes: int) -> int:
    """Fewer rows beyond ``MOST_SOURCES`` classes, so that the matrix of their scores grows no further."""
    return max(1, rows * MOST_SOURCES // max(classes, MOST_SOURCES))


def train_softmax(rows: np.ndarray, labels: np.ndarray, classes: int, steps: int = 150, rate: float = 0.5, penalty: float = 1e-4) -> np.ndarray:
    """(WIDTH, classes) weights by full-batch Adam, the gradient summed over blocks of rows; deterministic."""
    weights, first, second, height = np.zeros((rows.shape[1], classes), np.float32), 0.0, 0.0, rows_at_once(TRAINED, classes)
    for step in range(1, steps + 1):
        grad = penalty * weights
        for at in range(0, len(rows), height):
            part = rows[at : at + height]
            wrong = posteriors(part, weights)
            wrong[np.arange(len(part)), labels[at : at + height]] -= 1
            grad += part.T @ wrong / len(rows)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
    return weights


def posteriors(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scores = rows @ weights
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def labelled_sample(docs: DataFrame, key: str, text: str, source: str, sources: list[str], per_source: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``per_source`` documents of each source, those with the smallest hashes.

    The features come to a nameless file of the driver, 4 kB for each document, and are mapped from there.
    """
    first = W.partitionBy(source).orderBy(F.xxhash64(F.lit(3), key), key)
    chosen = docs.filter(F.col(source).isin(sources) & (F.length(text) > 0)).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_source)
    index = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, JUDGED):
                batch = whole.slice(at, JUDGED)
                yield pa.RecordBatch.from_arrays([pa.array([index[x] for x in batch[0].to_pylist()], pa.int32()), batch[2], pa.array([zlib.compress(x.astype(np.float32).tobytes(), 1) for x in hashed_pairs(batch[1].to_pylist())], pa.binary())], ["label", "place", "row"])

    table, counts = materialize(chosen.select(source, text, "_r").mapInArrow(run, "label int, place int, row binary")), np.zeros(len(sources), np.int64)
    for r in table.groupBy("label").count().collect():  # one row for each source
        counts[r["label"]] = r["count"]
    starts, rows = np.cumsum(counts) - counts, np.zeros((0, WIDTH), np.float32)
    if counts.sum():
        with tempfile.TemporaryFile() as file:
            for r in table.repartition(-(-int(counts.sum()) // ROWS_AT_ONCE), "label", "place").toLocalIterator():  # one part at a time
                file.seek(int(starts[r["label"]] + r["place"] - 1) * 4 * WIDTH)  # in order of source and hash, wherever the rows lie
                file.write(zlib.decompress(r["row"]))
            file.flush()
            rows = np.memmap(file, np.float32, "r", shape=(int(counts.sum()), WIDTH))
    discard(table)
    return rows, np.repeat(np.arange(len(sources)), counts)


@dataclass
class Mix:
    """One mix over the indexed sources: share, repeats and target tokens of each."""

    mix_id: int
    share: np.ndarray
    cap: np.ndarray
    target: np.ndarray


def plan_mixes(targets: list, sources: list[str], tokens: dict[str, int]) -> list[Mix]:
    mixes = []
    for mix_id in sorted({r["mix_id"] for r in targets}):
        share, cap = np.zeros(len(sources)), np.zeros(len(sources))
        for r in targets:
            if r["mix_id"] == mix_id and r["source"] in sources and (r["weight"] or 0) > 0 and tokens.get(r["source"], 0) and (r["max_repeats"] or 0) > 0:
                i = sources.index(r["source"])
                share[i] += r["weight"]
                cap[i] = r["max_repeats"]
        if share.sum():
            share /= share.sum()
            total = min(cap[i] * tokens[s] / share[i] for i, s in enumerate(sources) if share[i] > 0)
            mixes.append(Mix(mix_id, share, cap, share * total))
    return mixes


@dataclass
class Mixed:
    """(mix_id, key, source, tokens, rate, repeats) of the chosen documents, and what the fit came to.

    ``fit`` has a row (mix_id, source, target, expected, fitted) for each source of a mix: target tokens, expected tokens
    by posterior after the last step, expected tokens by the sources' own names at that point.
    """

    chosen: DataFrame
    fit: list[tuple[int, str, float, float, float]]


def sparse(post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the rows, domains, values) of the posteriors that matter; every row has one at least."""
    keep = post >= LEAST
    keep[np.arange(len(post)), post.argmax(1)] = True
    row, domain = np.nonzero(keep)
    values = post[row, domain]
    values = values / np.bincount(row, values, len(post))[row]
    return np.concatenate([[0], np.cumsum(keep.sum(1))]), domain.astype(np.int32), values.astype(np.float32)


def membership(offsets: np.ndarray, domain: np.ndarray, value: np.ndarray, label: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The values over the domains of one mix, summing to one in each row; zero where a row has none of them."""
    inside = np.where(share[domain] > 0, value, 0.0)
    total = np.add.reduceat(inside, offsets[:-1])
    return inside / np.repeat(np.where(total > 0, total, 1.0), np.diff(offsets))


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, vocabulary: str = VOCABULARY, steps: int = STEPS) -> Mixed:
    """Mixes of the documents to the small table of weights ``targets``."""
    wanted = targets.collect()
    names = sorted({r["source"] for r in wanted if r["source"] is not None})
    index, key_type, spark = {s: i for i, s in enumerate(names)}, dict(docs.dtypes)[key], docs.sparkSession
    nothing = Mixed(spark.createDataFrame([], f"mix_id int, {key} {key_type}, {source} string, tokens bigint, rate double, repeats bigint"), [])
    if not names:
        return nothing
    rows, labels = labelled_sample(docs, key, text, source, names)
    if not len(rows):
        return nothing
    weights, height = train_softmax(rows, labels, len(names)), rows_at_once(JUDGED, len(names))
    del rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for whole in batches:
            for at in range(0, whole.num_rows, height):  # bounded matrices of features and scores
                batch = whole.slice(at, height)
                texts, label = batch[2].to_pylist(), np.array([index[x] for x in batch[1].to_pylist()], np.int32)
                offsets, domain, value = sparse(posteriors(hashed_pairs(texts), weights))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (domain, value)]
                yield pa.RecordBatch.from_arrays([batch[0], pa.array(label), pa.array([len(encode(x)) for x in texts], pa.int64()), *lists], ["key", "source", "tokens", "domain", "value"])

    present = docs.select(key, source, text).filter(F.col(key).isNotNull() & F.col(source).isin(names) & (F.length(text) > 0))
    judged = materialize(present.mapInArrow(judge, f"key {key_type}, source int, tokens bigint, domain array<int>, value array<float>").filter("tokens > 0"))
    sums = {names[r["source"]]: r["tokens"] for r in judged.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    mixes = plan_mixes(wanted, names, sums)
    if not mixes:
        return nothing
    have = np.array([float(sums.get(s, 0)) for s in names])
    moves: list[list[np.ndarray]] = [[] for _ in mixes]

    def rates(batch: pa.RecordBatch) -> Iterator[tuple[Mix, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        label, size = batch["source"].to_numpy(), batch["tokens"].to_numpy().astype(float)
        offsets, domain = np.concatenate([[0], np.cumsum(batch["domain"].value_lengths().to_numpy())]), batch["domain"].flatten().to_numpy()
        value = batch["value"].flatten().to_numpy()
        for m, mix_plan in enumerate(mixes):
            cap, member = mix_plan.cap[label], membership(offsets, domain, value, label, mix_plan.share)
            rate = np.minimum(mix_plan.target[label] / np.maximum(have[label], 1.0), cap)
            for step in moves[m]:
                rate = np.clip(rate + np.add.reduceat(member * step[domain], offsets[:-1]), 0.0, cap)
            yield mix_plan, label, size, rate, domain, member * np.repeat(rate * size, np.diff(offsets))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        soft, hard = np.zeros((len(mixes), len(names))), np.zeros((len(mixes), len(names)))
        for batch in batches:
            if batch.num_rows:
                for m, (_, label, size, rate, domain, mass) in enumerate(rates(batch)):
                    soft[m] += np.bincount(domain, mass, len(names))
                    hard[m] += np.bincount(label, rate * size, len(names))
        m, d = np.nonzero(soft + hard)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m, d, soft[m, d], hard[m, d])], ["m", "d", "soft", "hard"])

    def summed() -> tuple[np.ndarray, np.ndarray]:
        soft, hard = np.zeros((len(mixes), len(names))), np.zeros((len(mixes), len(names)))
        parts = judged.mapInArrow(totals, "m bigint, d bigint, soft double, hard double").groupBy("m", "d").agg(F.sum("soft").alias("soft"), F.sum("hard").alias("hard"))
        for r in parts.collect():  # one row for each source of each mix
            soft[r["m"], r["d"]], hard[r["m"], r["d"]] = r["soft"], r["hard"]
        return soft, hard

    soft, hard = summed()
    for step in range(steps):
        if all((np.abs(plan.target - soft[m]) <= RESIDUAL * plan.target.sum()).all() for m, plan in enumerate(mixes)):
            break
        for m, plan in enumerate(mixes):
            moves[m].append((plan.target - soft[m]) / np.maximum(have, 1.0) * np.where(plan.share > 0, 1.0, 0.0) / (1 + step / 8))
        soft, hard = summed()
    fit = [(plan.mix_id, names[i], float(plan.target[i]), float(soft[m][i]), float(hard[m][i])) for m, plan in enumerate(mixes) for i in np.flatnonzero(plan.share)]
    lower = np.stack([np.minimum(plan.target / np.maximum(hard[m], 1e-9), 1.0) for m, plan in enumerate(mixes)])
    lift = np.stack([np.clip((plan.target - hard[m]) / np.maximum(plan.cap * have - hard[m], 1e-9), 0.0, 1.0) for m, plan in enumerate(mixes)])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for m, (plan, label, size, rate, _, _) in enumerate(rates(batch)):
                rate = rate * lower[m][label]
                rate = rate + lift[m][label] * (plan.cap[label] - rate)
                keep = rate > 0
                if keep.any():
                    chosen = np.flatnonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), plan.mix_id), pa.int32()), batch["key"].take(pa.array(chosen)), pa.array([names[x] for x in label[chosen]]), pa.array(size[chosen].astype(np.int64)), pa.array(rate[chosen])], ["mix_id", "key", "source", "tokens", "rate"])

    fitted = materialize(judged.mapInArrow(final, f"mix_id int, key {key_type}, source string, tokens bigint, rate double"))
    drawn = materialize(drawing(fitted))
    goals = [(plan.mix_id, names[i], float(plan.target[i])) for plan in mixes for i in np.flatnonzero(plan.share)]
    changes = settling(drawn, spark.createDataFrame(goals, "mix_id int, source string, target double"), key_type)
    settled = drawn.join(changes, ["mix_id", "source", "start", "key"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("change", F.lit(0)))
    return Mixed(settled.filter("repeats > 0").select("mix_id", F.col("key").alias(key), F.col("source").alias(source), "tokens", "rate", "repeats"), fit)


def drawing(fitted: DataFrame) -> DataFrame:
    """(mix_id, key, source, tokens, rate, start, repeats) by systematic rounding over running totals of the rates.

    The order within a source is (tokens, hash, key) at every size.  A bucket of the totals is one length, or a range of
    the hashes in it where many documents of a source share a length, so buckets follow that order and their number
    changes nothing.  The one window over the buckets of a source has a row for each length and range.
    """
    least = F.xxhash64(F.lit(31), "key")
    most = fitted.groupBy("mix_id", "source", "tokens").count().agg(F.max("count")).first()[0]
    ranges = buckets_for(most or 0)
    place = F.shiftright((F.shiftright(least, 32) + F.lit(1 << 31)) * F.lit(ranges), 32)  # the upper half of the hash, as a part of its span
    ordered = fitted.withColumn("hb", F.col("tokens") * ranges + place)
    started = running_total(ordered, ["mix_id", "source"], "hb", [F.col("tokens"), least, F.col("key")], "rate", "start")
    offset = F.pmod(F.xxhash64(F.lit(37), "mix_id", "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    repeats = (F.floor(F.col("start") + F.col("rate") + offset + 1e-9) - F.floor(F.col("start") + offset + 1e-9)).cast("bigint")
    return started.withColumn("repeats", repeats).select("mix_id", "key", "source", "tokens", "rate", "start", "repeats")


def settling(drawn: DataFrame, goals: DataFrame, key_type: str) -> DataFrame:
    """(mix_id, source, start, key, change): the documents to round the other way, so that each source has its target tokens.

    At most ``SETTLE`` documents of each length class of a source, up and down, are weighed, whatever the data; the one
    that brings the source nearest to its target goes first, until none does.  Rows that repeat a key differ in their
    start.
    """
    over = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("got")).join(goals, ["mix_id", "source"]).select("mix_id", "source", (F.col("got") - F.col("target")).alias("over"))
    change = F.when(F.col("repeats") > F.floor("rate"), -1).when(F.col("repeats") < F.ceil("rate"), 1)
    movable = drawn.withColumn("change", change).filter("change IS NOT NULL").join(over, ["mix_id", "source"]).filter(F.col("tokens") < 2 * F.abs("over"))
    own, least = ["mix_id", "source", "change", "c"], F.xxhash64(F.lit(41), "key")
    few = cap_per_key(movable.withColumn("c", F.floor(F.log2(F.col("tokens").cast("double")) * 4).cast("int")), own, [least, F.col("key")], SETTLE)
    lists = few.groupBy("mix_id", "source", "over").agg(F.sort_array(F.collect_list(F.struct("tokens", least.alias("h"), "key", "start", "change")), asc=False).alias("documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for mix_id, source, over, documents in zip(*(batch[c].to_pylist() for c in ("mix_id", "source", "over", "documents")), strict=True):
                moves = np.array([float(d["tokens"] * d["change"]) for d in documents])
                while True:
                    best = int(np.abs(over + moves).argmin())
                    if not abs(over + moves[best]) < abs(over):
                        break
                    over, moves[best] = over + moves[best], np.inf
                    d = documents[best]
                    found.append((mix_id, source, d["start"], d["key"], d["change"]))
            kinds = [pa.int32(), pa.string(), pa.float64(), batch.schema.field("documents").type.value_type.field("key").type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["mix_id", "source", "start", "key", "change"])

    return lists.mapInArrow(run, f"mix_id int, source string, start double, key {key_type}, change bigint")
