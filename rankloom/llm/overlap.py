"""Same or nearly same records across splits, by content-defined chunks.

A normalised record is cut wherever the rolling hash of its last ``WINDOW`` characters meets a mask; the cuts depend on
the content alone.  An edit changes the hash at WINDOW places, so it changes at most WINDOW + 1 chunks: of the m chunks
of a record of n characters at least m - (WINDOW + 1) k survive in any record within k edits, where k = floor(n / 7)
bounds one edit in eight characters of the longer record.

Candidates share a chunk digest (and the group, here the form of the gold).  By the prefix principle it is enough that each record offers its first (WINDOW + 1) k + 1 chunks in one global
order; the order is longest chunk first, then by digest, so offered chunks are rare ones.  A record with too few chunks
for the bound offers single characters as well; two such records then meet on those.  Therefore no pair within the bound
is lost.  The exact check of the edits follows.  Chunks that very many records of a group offer are joined by salt.

``record_fractions`` sums, for every record of one side, the lengths of its chunks that the other side has too.

Records with equal group and text are one class: the joins work on classes, reports on class sizes, and copies are only
expanded where rows are asked for.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import to_hiragana
from rankloom.llm.lookalike import canonical_ctes, map_batches
from rankloom.operators.skew import hot_join, salted_lookup
from rankloom.session import materialize

#: Characters of the rolling window; a cut where the hash meets this mask, so after about every second character.
WINDOW, MASK = 3, 1
#: At most one edit in so many characters of the longer record.
EDITS_IN = 8

_UNSEEN = re.compile("[\\s­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ\U000e0001-\U000e01ef]")


@F.pandas_udf(T.StringType())
def consistent(values: pd.Series) -> pd.Series:
    """NFKC without white space and unseen characters; null gives the empty string."""
    return values.map(lambda x: "" if x is None else _UNSEEN.sub("", unicodedata.normalize("NFKC", _UNSEEN.sub("", x))))


def chunk_lengths(text: str, window: int = WINDOW, mask: int = MASK) -> list[int]:
    """Lengths of the chunks of a text, by a polynomial rolling hash over its characters."""
    lengths, start, value, drop = [], 0, 0, pow(1_000_003, window, 1 << 64)
    for i, char in enumerate(text):
        value = (value * 1_000_003 + ord(char) + 0x9E37) & 0xFFFFFFFFFFFFFFFF
        if i >= window:
            value = (value - drop * (ord(text[i - window]) + 0x9E37)) & 0xFFFFFFFFFFFFFFFF
        if not ((value * 0x9E3779B97F4A7C15) >> 40) & mask:
            lengths.append(i + 1 - start)
            start = i + 1
    if start < len(text):
        lengths.append(len(text) - start)
    return lengths


def _tagged(parts: list[str], scheme: int) -> list[tuple[int, int]]:
    """(length, digest) of each part; the digest counts which occurrence of the part it is."""
    seen: dict[str, int] = {}
    out = []
    for part in parts:
        seen[part] = count = seen.get(part, 0) + 1
        out.append((len(part), xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), seed=scheme * 1_000_003 + count) - (1 << 63)))
    return out


def chunks(text: str) -> list[tuple[int, int]]:
    parts, at = [], 0
    for length in chunk_lengths(text):
        parts.append(text[at : at + length])
        at += length
    return _tagged(parts, 1)


def offered(text: str) -> list[int]:
    """Digests of the chunks by which a record is found; an empty record offers one fixed key."""
    if not text:
        return [0]
    lost = (WINDOW + 1) * (len(text) // (EDITS_IN - 1))
    own = chunks(text)
    keys = sorted(own, key=lambda x: (-x[0], x[1]))[: lost + 1]
    if len(own) <= lost:
        edits = len(text) // (EDITS_IN - 1)
        keys += sorted(_tagged(list(text), 2), key=lambda x: x[1])[: edits + 1]
    return [digest for _, digest in keys]


_CHUNK = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("chunk", T.LongType())]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def offered_udf(values: pd.Series) -> pd.Series:
    return values.map(offered)


@F.pandas_udf(_CHUNK)
def chunks_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda x: [{"length": a, "chunk": b} for a, b in chunks(x)])


def _shared_groups(sides: list[DataFrame], column: str) -> DataFrame:
    """(v, form): the strings of the column whose form occurs on both sides."""
    tagged = [df.select(F.col(column).alias("v"), F.lit(1 << i).alias("side")) for i, df in enumerate(sides)]
    strings = tagged[0].unionByName(tagged[1]).filter("v IS NOT NULL").groupBy("v").agg(F.bit_or("side").alias("side"))
    sql = f"WITH strings AS (SELECT v FROM t), {canonical_ctes()} SELECT t.v, side, form FROM t JOIN canonical c ON c.v = t.v"
    forms = materialize(map_batches(strings, sql, "v string, side int, form string", pa.schema([("v", pa.string()), ("side", pa.int32()), ("form", pa.string())])))
    both = forms.groupBy("form").agg(F.bit_or("side").alias("side")).filter("side = 3").select("form")
    return materialize(salted_lookup(forms, both, ["form"], [F.col("v")], "left_semi").select("v", "form"))


def _records(df: DataFrame, groups: DataFrame, key: str, group: str, reading: str, context: str) -> DataFrame:
    """(id, form, blank, body, class): the rows whose group occurs on both sides, in consistent form."""
    rows = df.select(F.col(key).alias("id"), F.col(group).alias("v"), F.col(reading).alias("reading"), F.col(context).alias("context")).filter("id IS NOT NULL AND v IS NOT NULL AND reading IS NOT NULL")
    rows = salted_lookup(rows, groups, ["v"], [F.col("id")])
    rows = rows.select("id", "form", to_hiragana(consistent(F.col("reading"))).alias("reading"), consistent(F.col("context")).alias("context"))
    rows = rows.select("id", "form", (F.col("context") == "").alias("blank"), F.concat(F.regexp_replace("reading", "[・･]", ""), "context").alias("body"))
    return rows.withColumn("class", F.md5(F.concat_ws("\x01", "form", F.col("blank").cast("string"), "body")))


@dataclass
class Overlaps:
    """Rows (id, class) of both sides, their classes (class, form, blank, body), and (a, b, edits) of the classes that meet."""

    left: DataFrame
    right: DataFrame
    left_classes: DataFrame
    right_classes: DataFrame
    pairs: DataFrame


def near_classes(left: DataFrame, right: DataFrame, key: str, group: str, reading: str, context: str) -> Overlaps:
    """The classes of equal records of the two tables, and which of them are the same or nearly so.

    The groups must look the same; reading followed by context, in consistent form, may differ in one character in
    eight of the longer; either both contexts are blank or neither is.  Rows with a null reading or group never count,
    a null context is blank.
    """
    groups = _shared_groups([left, right], group)
    a, b = (materialize(_records(df, groups, key, group, reading, context)) for df in (left, right))

    def classes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("class").agg(F.first("form").alias("form"), F.first("blank").alias("blank"), F.first("body").alias("body"))

    def keys(found: DataFrame, name: str) -> DataFrame:
        return found.select(F.col("class").alias(name), F.hash("form", "blank").alias("scope"), F.length("body").alias(f"{name}_n"), F.explode(offered_udf(F.col("body"))).alias("chunk"))

    ca, cb = classes(a), classes(b)
    longer = F.greatest("a_n", "b_n")
    met = hot_join(keys(ca, "a"), keys(cb, "b"), ["scope", "chunk"], F.col("b")).filter(F.abs(F.col("a_n") - F.col("b_n")) * EDITS_IN <= longer).select("a", "b").distinct()
    texts = lambda df, name: df.select(F.col("class").alias(name), F.col("form").alias(f"{name}_form"), F.col("blank").alias(f"{name}_blank"), F.col("body").alias(f"{name}_body"))
    pairs = met.join(texts(ca, "a"), "a").join(texts(cb, "b"), "b").filter("a_form = b_form AND a_blank = b_blank")
    allowed = F.floor(F.greatest(F.length("a_body"), F.length("b_body")) / EDITS_IN).cast("int")
    pairs = pairs.withColumn("edits", F.call_function("levenshtein", F.col("a_body"), F.col("b_body"), allowed)).filter("edits >= 0")
    return Overlaps(a.select("id", "class"), b.select("id", "class"), ca, cb, pairs.select("a", "b", "edits"))


def near_pairs(left: DataFrame, right: DataFrame, key: str, group: str, reading: str, context: str) -> DataFrame:
    """(left_id, right_id, edits): the rows of ``near_classes``; repeated rows count each."""
    found = near_classes(left, right, key, group, reading, context)
    left_rows = found.left.select(F.col("id").alias("left_id"), F.col("class").alias("a"))
    right_rows = found.right.select(F.col("id").alias("right_id"), F.col("class").alias("b"))
    return found.pairs.join(left_rows, "a").join(right_rows, "b").select("left_id", "right_id", "edits")


def record_fractions(found: Overlaps) -> DataFrame:
    """(class, fraction) of the left classes: the summed length of their chunks that the right side has in the same group.

    The chunks of the right side are distinct before the join, so a chunk of every record costs one row; a record
    without characters that meets one like it has the fraction 1.
    """

    def exploded(classes: DataFrame) -> DataFrame:
        return classes.select("class", "form", "blank", F.length("body").alias("n"), F.explode(chunks_udf(F.col("body"))).alias("c")).select("class", "form", "blank", "n", "c.length", "c.chunk")

    there = exploded(found.right_classes).select("form", "blank", "chunk").distinct()
    shared = hot_join(there, exploded(found.left_classes), ["form", "blank", "chunk"], F.col("class"))
    sums = shared.groupBy("class").agg((F.sum("length") / F.first("n")).alias("fraction"))
    full = found.left_classes.filter("body <> ''").select("class").join(sums, "class", "left").select("class", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))
    # At most one class of each group has no characters.
    blank = found.left_classes.filter("body = ''").select("class", "form", "blank")
    met = found.right_classes.filter("body = ''").select("form", "blank", F.lit(1.0).alias("fraction"))
    return full.unionByName(blank.join(met, ["form", "blank"], "left").select("class", F.coalesce("fraction", F.lit(0.0)).alias("fraction")))
