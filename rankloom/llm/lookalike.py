"""One form for texts a reader cannot tell apart, as DuckDB SQL that runs inside Arrow partitions.

``canonical_ctes`` is the SQL; ``canonical_map`` applies it to the distinct strings of a column.  Steps, in order:

1. drop white space, format characters, controls, variation selectors and blank fillers;
2. full-width ASCII and half-width kana to their usual width, then NFC (composes accents and voicing marks, and
   replaces canonical duplicates of ideographs);
3. only where such characters occur: compatibility forms, radicals and letters of other scripts to the usual letter;
4. kana that have the shape of an ideograph (and dashes, which have the shape of the long-vowel mark) take the
   script of the run they stand in: katakana in a run with other katakana, else hiragana or ideographs.

Results for edge cases: null stays null, a text of blanks only becomes the empty string, length is unbounded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes that letters of other scripts share with Latin letters.
CYRILLIC_FROM, CYRILLIC_TO = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw"
GREEK_FROM, GREEK_TO = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν", "ABEZHIKMNOPTYXoiv"

# Radicals (Unicode block CJK Radicals Supplement) with the shape of an ideograph.
RADICAL_FROM = "⺁⺄⺅⺆⺋⺍⺎⺐⺒⺓⺔⺕⺖⺘⺙⺛⺝⺞⺟⺠⺡⺢⺣⺤⺦⺨⺪⺫⺭⺯⺰⺱⺲⺶⺹⺺⺻⺽⻁⻂⻃⻅⻈⻉⻋⻌⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻲⻳"
RADICAL_TO = "厂乙亻冂卩⺍兀尢巳幺彑彐忄扌攵旡月歺母民氵氺灬爫丬犭疋罒礻糹纟罓罒羊耂肀聿臼虎衤覀见讠贝车辶钅長镸长门阝雨青韦页风飞飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙亀龟"

# Kana with the shape of an ideograph, kana of equal shape in both syllabaries, dashes, dots, circles.
KANA_SHAPED, IDEOGRAPH_SHAPED = "カタロニオハエトノ", "力夕口二才八工卜丿"
KATAKANA_SAME, HIRAGANA_SAME = "ヘベペ", "へべぺ"
LONG_MARK, ONE = "ー", "一"
DASHES = "-‐‑‒–—―−─━ㅡ"
DOTS, DOT = "·‧•∙⋅", "・"
CIRCLES, CIRCLE = "○◯", "〇"

INVISIBLE = r"[\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"

#: Compatibility tags that keep a letter's shape; raised, lowered, circled and squared forms look different.
SAME_SHAPE_TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def width_pair() -> tuple[str, str]:
    """Full-width ASCII and half-width kana with what they become; voicing marks become combining ones."""
    pairs = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    for code in range(0xFF61, 0xFF9E):
        pairs[chr(code)] = unicodedata.normalize("NFKC", chr(code))
    pairs |= {"ﾞ": "゙", "ﾟ": "゚", "゛": "゙", "゜": "゚"}
    return "".join(pairs), "".join(pairs.values())


@lru_cache(maxsize=1)
def compatibility_map() -> dict[str, str]:
    """Every other character whose compatibility form has the same shape, by rule from the Unicode data."""
    width = set(width_pair()[0])
    found: dict[str, str] = {}
    for low, high in ((0xA0, 0x3400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x2F800, 0x2FA20)):
        for code in range(low, high):
            char = chr(code)
            tag = unicodedata.decomposition(char).partition(" ")[0]
            if char in width or not tag or tag.startswith("<") and tag not in SAME_SHAPE_TAGS:
                continue
            form = "".join(x for x in unicodedata.normalize("NFKC", char) if not x.isspace())
            if form != char and form:
                found[char] = form
    found |= dict(zip(CYRILLIC_FROM + GREEK_FROM, CYRILLIC_TO + GREEK_TO, strict=True))
    found |= dict(zip(RADICAL_FROM, RADICAL_TO, strict=True))
    return {a: b for a, b in found.items() if a != b}


def _ranges(chars: list[str]) -> str:
    """A regular-expression class for the characters, as code-point ranges."""
    codes, parts = sorted(map(ord, chars)), []
    start = last = codes[0]
    for code in [*codes[1:], None]:
        if code is not None and code == last + 1:
            last = code
            continue
        parts.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
        if code is not None:
            start = last = code
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=1)
def canonical_ctes() -> str:
    """CTEs from ``strings(v)`` to ``canonical(v, form)``; v must be distinct."""
    width_from, width_to = width_pair()
    compat = compatibility_map()
    rare = _ranges(list(compat))
    keys = "[" + ", ".join(map(_quote, compat)) + "]"
    values = "[" + ", ".join(map(_quote, compat.values())) + "]"
    fold_from = DASHES + DOTS + CIRCLES
    fold_to = LONG_MARK * len(DASHES) + DOT * len(DOTS) + CIRCLE * len(CIRCLES)
    shaped = KANA_SHAPED + IDEOGRAPH_SHAPED + KATAKANA_SAME + HIRAGANA_SAME + LONG_MARK + ONE
    katakana = "".join(c for c in map(chr, range(0x30A1, 0x30FB)) if c not in KANA_SHAPED + KATAKANA_SAME)
    hiragana = "".join(c for c in map(chr, range(0x3041, 0x3097)) if c not in HIRAGANA_SAME)
    to_katakana = (IDEOGRAPH_SHAPED + HIRAGANA_SAME + ONE, KANA_SHAPED + KATAKANA_SAME + LONG_MARK)
    to_ideograph = (KANA_SHAPED + KATAKANA_SAME + LONG_MARK, IDEOGRAPH_SHAPED + HIRAGANA_SAME + ONE)
    to_hiragana = (KANA_SHAPED + KATAKANA_SAME + ONE, IDEOGRAPH_SHAPED + HIRAGANA_SAME + LONG_MARK)
    run = f"[{shaped}{katakana}{hiragana}]+|[^{shaped}{katakana}{hiragana}]+"
    return f"""
    bare AS (SELECT v, regexp_replace(v, {_quote(INVISIBLE)}, '', 'g') AS a FROM strings WHERE v IS NOT NULL),
    wide AS (SELECT v, nfc_normalize(CASE WHEN regexp_matches(a, '[\\x{{FF01}}-\\x{{FF9F}}\\x{{309B}}\\x{{309C}}]') THEN translate(a, {_quote(width_from)}, {_quote(width_to)}) ELSE a END) AS b FROM bare),
    compat_table AS (SELECT unnest({keys}) AS k, unnest({values}) AS form),
    compat AS (SELECT map(list(k), list(form)) AS m FROM compat_table),
    plain AS (SELECT v, CASE WHEN regexp_matches(b, {_quote(rare)})
        THEN nfc_normalize(list_aggregate(list_transform(string_split(b, ''), lambda x: coalesce(m[x], x)), 'string_agg', '')) ELSE b END AS c FROM wide, compat),
    folded AS (SELECT v, CASE WHEN regexp_matches(c, {_quote(f"[{fold_from.replace('-', '')}-]")}) THEN translate(c, {_quote(fold_from)}, {_quote(fold_to)}) ELSE c END AS d FROM plain),
    canonical AS (SELECT v, CASE WHEN NOT regexp_matches(d, '[{shaped}]') THEN d ELSE
        list_aggregate(list_transform(regexp_extract_all(d, {_quote(run)}), lambda x: CASE
            WHEN NOT regexp_matches(x, '[{shaped}]') THEN x
            WHEN regexp_matches(x, '[{katakana}]') THEN translate(x, {_quote(to_katakana[0])}, {_quote(to_katakana[1])})
            WHEN regexp_matches(x, '[{hiragana}]') THEN translate(x, {_quote(to_hiragana[0])}, {_quote(to_hiragana[1])})
            ELSE translate(x, {_quote(to_ideograph[0])}, {_quote(to_ideograph[1])}) END), 'string_agg', '') END AS form FROM folded)"""


class Engine:
    """An in-memory DuckDB of one thread in a Python worker, for SQL over Arrow batches."""

    def __init__(self) -> None:
        import duckdb

        self.connection = duckdb.connect(":memory:", config={"threads": 1})

    def run(self, sql: str, **tables: pa.Table | pa.RecordBatch) -> pa.Table:
        for name, table in tables.items():
            self.connection.register(name, pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table)
        try:
            return self.connection.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.connection.unregister(name)


def _as(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.select(schema.names).cast(schema).to_batches()


def map_batches(df: DataFrame, sql: str, schema: str, arrow: pa.Schema) -> DataFrame:
    """Run SQL with ``t`` standing for each Arrow batch; one engine for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Engine()
        for batch in batches:
            if batch.num_rows:
                yield from _as(engine.run(sql, t=batch), arrow)

    return df.mapInArrow(run, schema)


def canonical_map(values: DataFrame, column: str) -> DataFrame:
    """(v, form): each distinct non-null string of the column with its one form.

    The distinct is an ordinary pre-aggregated shuffle, so a string that fills a third of the rows costs one row.
    """
    distinct = values.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
    sql = f"WITH strings AS (SELECT v FROM t), {canonical_ctes()} SELECT v, form FROM canonical"
    return map_batches(distinct, sql, "v string, form string", pa.schema([("v", pa.string()), ("form", pa.string())]))


def lookalike_members(df: DataFrame, id_column: str, column: str, salts: int = 16) -> DataFrame:
    """Ids of rows whose value has the same form as a different string elsewhere in the column.

    All rows of such a family count, rows with the plain string too; null never does; repeated rows each count.
    The join back to the rows spreads each family over ``salts`` tasks, so a hot string is no hot task.
    """
    from rankloom.session import materialize

    forms = materialize(canonical_map(df, column))
    families = forms.groupBy("form").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high").select("form")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    strings = forms.join(families, "form", "left_semi").select("v", spread.alias("salt"))
    rows = df.select(F.col(id_column).alias("row_key"), F.col(column).alias("v")).filter("v IS NOT NULL AND row_key IS NOT NULL")
    return rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int")).join(strings, ["v", "salt"], "left_semi").select("row_key").distinct()


def lookalike_candidates(df: DataFrame, id_column: str, target: str, candidates: str) -> DataFrame:
    """Ids of rows with a candidate that has the target's form and is another string.

    Works row by row inside the Arrow batch, without a shuffle.  Null targets, null lists and null elements never count.
    """
    sql = f"""
    WITH pairs AS (SELECT row_key, gold, unnest(list_distinct(nbest)) AS cand FROM t WHERE gold IS NOT NULL),
    near AS (SELECT row_key, gold, cand FROM pairs WHERE cand IS NOT NULL AND cand <> gold),
    strings AS (SELECT gold AS v FROM near UNION SELECT cand FROM near), {canonical_ctes()}
    SELECT DISTINCT n.row_key FROM near n JOIN canonical g ON g.v = n.gold JOIN canonical c ON c.v = n.cand WHERE g.form = c.form"""
    rows = df.select(F.col(id_column).alias("row_key"), F.col(target).alias("gold"), F.col(candidates).alias("nbest")).filter("gold IS NOT NULL AND size(nbest) > 0 AND row_key IS NOT NULL")
    return map_batches(rows, sql, "row_key bigint", pa.schema([("row_key", pa.int64())])).distinct()


def canonical_rows(df: DataFrame, id_column: str, columns: list[str], lists: list[str]) -> DataFrame:
    """(row_key, field_name, position, value, form) for each non-null string of the columns and of the lists."""
    parts = [f"SELECT row_key, '{c}' AS field_name, 0 AS position, {c} AS value FROM t" for c in columns]
    parts += [f"SELECT row_key, '{c}' AS field_name, generate_subscripts({c}, 1) AS position, unnest({c}) AS value FROM t" for c in lists]
    sql = f"""
    WITH cells AS ({" UNION ALL ".join(parts)}), strings AS (SELECT DISTINCT value AS v FROM cells), {canonical_ctes()}
    SELECT row_key, field_name, position::INTEGER AS position, value, form FROM cells JOIN canonical ON v = value"""
    arrow = pa.schema([("row_key", pa.int64()), ("field_name", pa.string()), ("position", pa.int32()), ("value", pa.string()), ("form", pa.string())])
    rows = df.select(F.col(id_column).alias("row_key"), *columns, *lists)
    return map_batches(rows, sql, "row_key bigint, field_name string, position int, value string, form string", arrow)
