"""SQL for DuckDB that equals the text functions; used by the oracle queries only."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from rankloom.functions.text import HIRAGANA, KATAKANA, KEY_HIRAGANA, OLD_FORMS, PLACEHOLDER_SURFACES

WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@lru_cache(maxsize=1)
def _compat() -> tuple[str, str]:
    pairs = {}
    for low, high in ((0xA0, 0x3400), (0xF900, 0xFB00), (0xFE30, 0xFFEF)):
        for code in range(low, high):
            form = unicodedata.normalize("NFKC", chr(code))
            if len(form) == 1 and form != chr(code) and unicodedata.normalize("NFC", chr(code)) != form:
                pairs[chr(code)] = form
    pairs |= {"ﾞ": "゙", "ﾟ": "゚"}
    return "".join(pairs), "".join(pairs.values())


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    """NFKC for texts whose compatibility characters stand for one character each."""
    a, b = _compat()
    return f"nfc_normalize(translate({x}, {quote(a)}, {quote(b)}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def weak(x: str) -> str:
    return strip(nfkc(x))


def strong(x: str) -> str:
    return f"regexp_replace({nfkc(x)}, '[{WS}・･]', '', 'g')"


def key_norm(x: str) -> str:
    return f"regexp_replace(translate({nfkc(x)}, {quote(KATAKANA)}, {quote(KEY_HIRAGANA)}), '[{WS}・･]', '', 'g')"


def context_key(x: str) -> str:
    return f"translate({nfkc(x)}, {quote(KATAKANA)}, {quote(HIRAGANA)})"


def valid_key(x: str) -> str:
    return f"coalesce(length({x}) BETWEEN 2 AND 60 AND regexp_full_match({x}, '[ぁ-ゖー]+'), false)"


def meaningful(x: str) -> str:
    words = ", ".join(map(quote, PLACEHOLDER_SURFACES))
    return f"coalesce(length({x}) <= 80 AND {x} NOT IN ({words}) AND regexp_matches({x}, '[一-鿿]'), false)"


def clean_context(x: str, most: int = 50) -> str:
    r = lambda e, a, b, o="g": f"regexp_replace({e}, {quote(a)}, {quote(b)}, '{o}')"
    e = r(f"coalesce({x}, '')", r"\r\n|[\r\n\t]", " ")
    e = r(e, rf"\[[{WS}]*(?:edit|編集)[{WS}]*\]", "", "gi")
    e = r(e, r"={2,}[^=\n]*={2,}", " ")
    e = r(e, r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", r"\1")
    e = r(e, r"\[\d+\]|<ref\b[^>]*>.*?</ref>", "", "gis")
    e = r(e, r"={2,}", " ")
    for _ in range(2):
        e = r(e, rf"(^|[{WS}])[*＊#＃・]+([{WS}]|$)", " ")
    e = r(e, r"[ \t\x{3000}]+", " ")
    e = r(e, r"^[ \x{3000}]+|[ \x{3000}]+$", "")
    e = f"regexp_extract({e}, '[^。！？!?]*$')"
    e = r(e, r"^[ \x{3000}]+", "")
    return f"right({e}, {most})"


def linguistic(x: str) -> str:
    return f"coalesce(regexp_matches({x}, {quote('[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿ｦ-ﾝ]|' + chr(92) + 'p{L}')}), false)"


def junk(x: str) -> str:
    return f"(coalesce({x}, '') = '' OR regexp_matches({x}, '[{OLD_FORMS}]') OR regexp_full_match({x}, '[｡-ﾟ]+') OR regexp_full_match({x}, '[{WS}]*[゠-ヿｦ-ﾝ][{WS}゠-ヿｦ-ﾝ]*'))"
