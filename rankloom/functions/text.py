"""Scalar text functions as Columns.

Everything is a built-in expression except NFKC, which Spark lacks; ``nfkc`` is an Arrow UDF and the composed norms
call it once.  Unicode classes need ``(?U)`` in Spark's regular expressions; ``trim`` only knows the ASCII space.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
#: The key norm folds the small ka and ke to the full-size letters, the context norm keeps them small.
KEY_HIRAGANA = HIRAGANA[:-2] + "かけ"
PLACEHOLDER_SURFACES = ("以下に掲載がない場合", "一円", "番地がくる場合")  # fixed values
OLD_FORMS = "實舊讃與學體廣應藝縣擧瀧靜"  # fixed values


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """NFKC; null stays null."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def strip(column: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def weak_surface(column: Column) -> Column:
    """NFKC and trim."""
    return strip(nfkc(column))


def strong_surface(column: Column) -> Column:
    """NFKC without white space and middle dots."""
    return F.regexp_replace(nfkc(column), r"(?U)[\s・･]", "")


def to_hiragana(column: Column) -> Column:
    """Katakana to hiragana; small ka and ke become full-size."""
    return F.translate(column, KATAKANA, KEY_HIRAGANA)


def to_hiragana_small(column: Column) -> Column:
    """Katakana to hiragana by the same offset for every letter; small ka and ke stay small."""
    return F.translate(column, KATAKANA, HIRAGANA)


def key_norm(column: Column) -> Column:
    """The key norm: NFKC, hiragana, no white space or middle dots."""
    return F.regexp_replace(to_hiragana(nfkc(column)), r"(?U)[\s・･]", "")


def context_key_norm(column: Column) -> Column:
    """The on-line key norm: NFKC and hiragana, white space kept."""
    return to_hiragana_small(nfkc(column))


def has_kanji(column: Column) -> Column:
    return column.rlike("[一-鿿]")


def valid_key(column: Column) -> Column:
    """2 to 60 hiragana or long marks."""
    return F.coalesce(F.length(column).between(2, 60) & column.rlike("^[ぁ-ゖー]+$"), F.lit(False))


def meaningful_surface(column: Column) -> Column:
    """At most 80 characters with an ideograph, and none of the placeholder entries."""
    return F.coalesce((F.length(column) <= 80) & ~column.isin(*PLACEHOLDER_SURFACES) & has_kanji(column), F.lit(False))


# What is taken out of a context or replaced in it, in this order.
CONTEXT_STEPS = (
    (r"\r\n|[\r\n\t]", " "),
    (r"(?iU)\[\s*(?:edit|編集)\s*\]", ""),
    (r"={2,}[^=\n]*={2,}", " "),
    (r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1"),
    (r"(?isU)\[\d+\]|<ref\b[^>]*>.*?</ref>", ""),
    (r"={2,}", " "),
    (r"(?U)(?:^|\s)[*＊#＃・]+(?=\s|$)", " "),
    ("[ \t　]+", " "),
    ("^[ 　]+|[ 　]+$", ""),
)


def clean_context(column: Column, max_chars: int = 50) -> Column:
    """Left context: markup dropped, text after the last sentence end, at most ``max_chars`` from the right.

    Null and empty give the empty string.
    """
    text = F.coalesce(column, F.lit(""))
    for pattern, replacement in CONTEXT_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    started = F.regexp_replace(F.regexp_extract(text, r"[^。！？!?]*\z", 0), "^[ 　]+", "")
    return F.when(F.lit(max_chars) <= 0, F.lit("")).otherwise(F.right(started, F.lit(max_chars)))


def cap_context(column: Column, cap: int) -> Column:
    """The last ``cap`` characters; nothing for a cap of zero or less."""
    return F.when(F.lit(cap) <= 0, F.lit("")).otherwise(F.right(F.coalesce(column, F.lit("")), F.lit(cap)))


LINGUISTIC = r"[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾝ]|\p{L}"


def linguistic(column: Column) -> Column:
    """Whether there is a kana, an ideograph or a letter."""
    return F.coalesce(column.rlike(LINGUISTIC), F.lit(False))


def junk_surface(column: Column) -> Column:
    """Empty, with an old form, all half-width kana, or katakana only (white space aside)."""
    text = F.coalesce(column, F.lit(""))
    return (text == "") | text.rlike(f"[{OLD_FORMS}]") | text.rlike(r"^[｡-ﾟ]+$") | text.rlike(r"(?U)^\s*[゠-ヿｦ-ﾝ][\s゠-ヿｦ-ﾝ]*$")
