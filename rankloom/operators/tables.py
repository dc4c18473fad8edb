"""Functions that turn a text or a record into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.text import strip


def log_errors() -> Column:
    """Codes of what a conversion-log row lacks."""
    none = F.lit("")
    return F.array_compact(
        F.array(
            F.when(F.coalesce("ts", none) == "", "missing:ts"), F.when(F.coalesce("reading", none) == "", "missing:reading"),
            F.when(F.col("nbest").isNull(), "missing:nbest"), F.when(F.coalesce("chosen", none) == "", "missing:chosen"),
        )
    )


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def strip_boilerplate(text: Column) -> Column:
    """The body after the second dashed line (the whole text without two), up to a line that starts a colophon."""
    lines = lines_of(text)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(r"(?U)^\s*-{20,}\s*$").alias("bar")))
    bars = F.filter(numbered, lambda x: x["bar"])
    first = F.when(F.size(bars) >= 2, F.get(bars, 1)["i"] + 1).otherwise(0)
    body = F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0)))
    stop = F.array_position(F.transform(body, lambda x: x.startswith("底本：")), F.lit(True)).cast("int")
    kept = F.when(stop > 0, F.slice(body, F.lit(1), stop - 1)).otherwise(body)
    return strip(F.array_join(kept, "\n"))


def ruby(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, implicit, surface, reading): explicit ruby first, then runs of ideographs with ruby, line by line."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.explode(lines_of(F.col(text))).alias("line"))
    explicit = F.transform(F.expr("regexp_extract_all(line, '｜[^《\\n]+《[^》\\n]+》', 0)"), lambda x: F.struct(F.lit(0).alias("implicit"), x.alias("x")))
    implicit = F.transform(F.expr("regexp_extract_all(line, '[一-鿿々〆ヶ]{1,20}《[^》\\n]+》', 0)"), lambda x: F.struct(F.lit(1).alias("implicit"), x.alias("x")))
    each = lines.select(key, F.inline(F.concat(explicit, implicit)))
    return each.select(key, "implicit", F.regexp_extract("x", "^｜?([^《]+)《", 1).alias("surface"), F.regexp_extract("x", "《([^》]+)》", 1).alias("reading"))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_id, char_begin, length): the offset is a running sum over the sentences of one text."""
    each = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.expr(f"regexp_extract_all({text}, '[^。！？!?]*[。！？!?]|[^。！？!?]+$', 0)")).alias("sent_id", "sentence"))
    before = W.partitionBy(key).orderBy("sent_id").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("sentence")
    return each.select(key, "sent_id", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint").alias("char_begin"), size.alias("length"))


# First levels of parts of speech that carry content; numbers in any script; what makes a token an address.
CONTENT = ("名詞", "動詞", "形容詞", "形状詞", "副詞", "連体詞")
DIGITS_ONLY = r"[0-9０-９一二三四五六七八九十百千万億兆.,．]+"
ADDRESS = r"https?://|www\.|@"

#: A run of one script, or a single character.
TOKEN = "[一-鿿々〆ヶ]+|[ァ-ヺー]+|[ぁ-ゖ][ぁ-ゖー]*|[A-Za-zＡ-Ｚａ-ｚ]+|[0-9０-９.,．，]*[0-9０-９][0-9０-９.,．，]*|[ \t\r\n　]+|(?s:.)"


def content_token(pos: Column, surface: Column) -> Column:
    """Whether a token carries content: its part of speech does, and it is neither a number (in any script) nor an address."""
    text = F.coalesce(surface, F.lit(""))
    return F.coalesce(F.get(pos, F.lit(0)).isin(*CONTENT), F.lit(False)) & ~text.rlike(f"^(?:{DIGITS_ONLY})$") & ~text.rlike(ADDRESS)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, sent_id, char_begin, token, pos): the tokens of every text, cut where the script changes.

    A stand-in for an analyser, which takes its place with the same columns: ideographs, katakana, letters and numbers
    count as nouns, hiragana as particles, the rest as symbols.  Offsets and sentence numbers are running sums over the
    tokens of one text.  Null texts have no tokens.
    """
    each = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("position", "token"))
    before = W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    ended = F.col("token").isin("。", "！", "？", "!", "?").cast("int")
    noun = F.col("token").rlike("^(?:[一-鿿々〆ヶ]+|[ァ-ヺー]+|[A-Za-zＡ-Ｚａ-ｚ]+|[0-9０-９.,．，]*[0-9０-９][0-9０-９.,．，]*)$")
    pos = F.when(noun, "名詞").when(F.col("token").rlike("^[ぁ-ゖ][ぁ-ゖー]*$"), "助詞").otherwise("補助記号")
    run = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    return each.select(key, "position", run(ended).alias("sent_id"), run(F.length("token")).alias("char_begin"), "token", pos.alias("pos"))
