"""Records that hold template residue, filler, error pages or demands for scripts instead of content.

1. Normalised lines are counted by host over all records (different texts, so copies do not count); lines that recur
   in enough texts of a host are boilerplate.
2. The boilerplate is subtracted from each record, unless nothing else would be left; the sentences of the residual are
   judged.  An open slot, or one filled with a program's word for "no value", anywhere in the residual is enough; error,
   script and filler sentences must make up half of the residual's sentences by length, so that articles about such
   things stay.
3. The first pass judges every record line by line for any evidence at all; only a record with some goes through the
   subtraction, which takes lines away and so can add none.  Both passes use the same patterns (``signs``).

Defined results: null and empty texts are not found (they have no residual); repeated rows are judged alike; a null or
odd url takes the record's source as host; lengths are unbounded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.skew import salted_lookup
from rankloom.session import materialize

#: A line is boilerplate of its host when this many different texts have it, and this share of the host's texts.
RECURS_IN, RECURS_SHARE = 4, 0.001
#: Evidence of a whole-page kind must fill this part of the residual's sentences.
PAGE_SHARE = 0.5

NAME = r"[a-z_][a-z0-9_.]*"
#: Words of markup templates that are no open slots.
WIKI_WORDS = r"(?:reflist|stub|toc|clear|notelist|fact|main|see|cite|quote|br)\b"
# Slots as they stand in folded (NFKC, lower-case) text.
SLOTS = [
    rf"\{{\{{\s*(?!{WIKI_WORDS}){NAME}\s*\}}\}}",
    rf"\{{%-?\s*{NAME}\s*-?%\}}",
    rf"<%=?\s*{NAME}\s*%>",
    rf"<<\s*{NAME}\s*>>",
    rf"[$#]\{{\s*{NAME}\s*\}}",
    rf"(?<![{{$#%])\{{\s*{NAME[:-1]}{{2,}}\s*\}}(?!\}})",
    rf"\[\[\s*{NAME}\s*\]\]",
    rf"%\({NAME}\)[sd]",
    rf"(?<![a-z0-9_%])%{NAME[:-1]}+%(?![a-z0-9_])",
    r"(?<![a-z0-9_])__[a-z][a-z0-9.]*(?:_[a-z0-9.]+)*__(?![a-z0-9_])",
    r"<[^<>\n]{0,20}(?:をここに|を)(?:挿入|入力|記入)[^<>\n]{0,6}>",
    r"[\[(【〔<][^\[\]()【】〔〕<>\n]{0,20}(?:未設定|未入力|未記入)[\])】〕>]",
    r"[\[(【〔][^\[\]()【】〔〕\n]{0,20}(?:ここに|を)[^\[\]()【】〔〕\n]{0,12}(?:入力|挿入|記入)(?:してください)?[\])】〕]",
    r"[\[(【〔]要[^\[\]()【】〔〕\n]{1,20}(?:記入|入力|確認)[\])】〕]",
    r"※[^※\n]{1,20}(?:差し替え|差替)[^※\n]{0,6}※",
]
NO_VALUE = [
    r"\[object object\]",
    r"invalid date",
    r"(?<![a-z0-9_\"'.])nan(?=[円個件人年月日回本枚台点名%])",
    r"(?<![a-z0-9_\"'.])(?:null|undefined|none)(?=[円個件人年月日回本枚台点名%]|さん|様|ページ|番|号|氏|丁目)",
    r"(?<![\"'\w])[^\W\d_]+\s*:\s*(?:undefined|null|nan|none)(?![a-z0-9_\"',}\]])",
]
#: What follows or surrounds notation that is only written about.
QUOTING = r"(?!\s*(?:[」』`\"']|のよう|という|といった|とい|と書|とは|と表|と記|など|は文字列|は整数|は[^。]{0,12}(?:表す|意味)|の記法|記法|の構文|構文|の書式|形式))"
OPEN_SLOT = re.compile("(?:" + "|".join(SLOTS) + ")" + QUOTING)
EMPTY_VALUE = re.compile("(?:" + "|".join(NO_VALUE) + ")" + QUOTING)

STATUS = r"(?:4(?:0\d|1\d|2\d|31|51)|5(?:0\d|1\d|2\d))"
REASON = (
    r"(?:bad request|unauthorized|forbidden|(?:page )?not found|method not allowed|request timeout|gone|too many requests|"
    r"internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
)
# What public servers, frameworks and blogs say instead of an article, in folded text.
ERROR_LINE = re.compile(
    rf"\W*(?:(?:http|error|status|ステータス|エラー(?:コード)?|http status)\W*)?{STATUS}\b\W*(?:{REASON})?\W*$|"
    rf"\W*(?:(?:http|error)\W*)?(?:{STATUS}\W*)?{REASON}\W*(?:{STATUS})?\W*$|"
    r"\W*(?:request id|ref|error id|trace id)\s*[:=]|\W*(?:php )?(?:warning|fatal error|notice): "
)
ERROR = re.compile(
    r"お探しの(?:ページ|記事|情報|商品)|(?:ページ|記事|ファイル|url)(?:が|は)(?:存在し|見つかりませ|削除され|移動し)|(?:見つかりません|存在しません)(?:でした)?\W*$|移動(?:された|した)可能性|削除された可能性|(?:表示|閲覧|アクセス)する権限がありません|権限がありません\W*$|"
    r"データベースに接続できません|接続できませんでした|サーバーに接続でき|内部でエラーが発生|エラーが(?:発生|起き)|しばらく(?:して|経って|時間をおいて)から(?:再度|もう一度)|時間をおいて(?:再度|もう一度)?(?:アクセス|お試し)|アクセスが集中し|メンテナンス(?:中です|を行って|のため)|ご不便をおかけ|ご迷惑をおかけ|"
    r"タイムアウト(?:しました|になりました)|セッションの有効期限|もう一度ログイン|ログインし(?:直し)?てください\W*$|予期しない(?:問題|エラー)|処理を中断しました|(?:url|アドレス)(?:の入力に|に)(?:誤り|間違い)|ただいま(?:混み合|アクセス)|"
    r"could not find what you|page you (?:requested|are looking|were looking)|something (?:broke|went wrong)|reload the page|try again (?:later|in)|upstream server|did not respond|access denied|(?:request|access) (?:was|has been) blocked|blocked by the site|"
    r"checking your browser|happens automatically|session (?:has )?(?:expired|timed out)|(?:please )?log ?in again|(?:under|for|down for|scheduled) maintenance|traceback \(most recent call last\)|file \"[^\"]+\", line \d|"
    r"undefined (?:index|variable|offset)|keyerror|stack trace|error establishing a database connection|this site can.t be reached|page isn.t working"
)
#: In a line that is no prose, between navigation.
LOOSE_ERROR = re.compile(rf"(?:http|error|status|ステータス|エラー(?:コード)?)\W*{STATUS}\b|\b{REASON}\b|request id\s*[:=]|\bref=[0-9a-f]")
SCRIPT_WORD = r"(?:java ?script|スクリプト|\bscripts?\b|cookie)"
SCRIPT = re.compile(
    rf"{SCRIPT_WORD}[^。]{{0,40}}(?:有効|オン|許可|無効|対応していません|使用しています|必要です|enabled?|turn|disabled|turned off|required|supported|to run)|"
    rf"(?:enable|turn on|allow|requires?|needs?)[^。.]{{0,30}}{SCRIPT_WORD}|scripts turned off|turn them on|ブラウザの設定をご確認|オンにしてから再読み込み|読み込(?:み中|んでい(?:ます|る))\W*$"
)
# Usual texts of layouts without content.
FILLER = re.compile(
    r"ダミー|サンプル(?:テキスト|サンプル|です|の文)|仮の(?:文|テキスト|本文|原稿)|仮(?:テキスト|文章|原稿)|ここに(?:テキスト|文章|本文|説明|内容)が入り|差し替え(?:ます|予定|る予定)|レイアウト確認|穴埋め|(?:本文|準備|工事)(?:は)?(?:準備|工事)?中(?:です)?\W*$|\(準備中\)|"
    r"あいうえおかき|いろはにほへと|[てテ][すス][とト](?:[てテ][すス][とト]|投稿|記事|です)|1234567890|abcdefg|asdf|lorem ipsum|dolor sit|placeholder text|(?:dummy|filler|sample) text|text goes here|insert (?:text|content)|coming soon|under construction"
)
#: A sentence of signs only, a piece that is repeated three times, a character four times.
EMPTY_LINE = re.compile(r"(?:[^\w\s]|_){4,}\W*$|(.{1,12}?)\1{2,}\W*$|(.)\2{3,}\W*$")
_FORMAT = re.compile("[­​-‏‪-‮⁠-⁯﻿︀-️]")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]{0,200})?/?>")
_LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d[t ]\d\d:\d\d|\[?(?:info|warn|warning|error|debug)\]?\s+\d|[\w.-]+\s*[=:]\s*\S+$|\{.*\}$)")
_ENDED = re.compile(r"[。！？!?.]\W*$")
_SENTENCE = re.compile(r"[^。！？!?\n]*[。！？!?]+[」』)]*|[^。！？!?\n]+")


def fold(text: str) -> str:
    return _FORMAT.sub("", unicodedata.normalize("NFKC", _FORMAT.sub("", text))).lower()


#: What every slot and every empty value contains; most lines have neither.
_SIGN, _VALUE = re.compile(r"[{<$#\[%_(【〔※]"), re.compile("object|invalid|nan|null|undefined|none")


def has_slot(text: str) -> bool:
    return bool(_SIGN.search(text) and OPEN_SLOT.search(text) or _VALUE.search(text) and EMPTY_VALUE.search(text))


def _bare(line: str) -> str:
    return _TAG.sub(" ", line) if "<" in line else line


def signs(lines: list[str]) -> dict[str, int]:
    """How many characters of the sentences of folded lines speak for each kind, and for content."""
    weights = {"error": 0, "script": 0, "filler": 0, "content": 0}
    seen: dict[str, int] = {}
    for line in lines:
        for sentence in _SENTENCE.findall(line):
            sentence = sentence.strip()
            size = len(sentence)
            if not size:
                continue
            seen[sentence] = seen.get(sentence, 0) + 1
            if SCRIPT.search(sentence):
                weights["script"] += size
            elif ERROR_LINE.match(sentence) or ERROR.search(sentence):
                weights["error"] += size
            elif FILLER.search(sentence) or EMPTY_LINE.match(sentence) or seen[sentence] > 2 and size > 3:
                weights["filler"] += size
            elif _ENDED.search(sentence):
                weights["content"] += size
            elif LOOSE_ERROR.search(sentence):
                weights["error"] += size
            elif size >= 40:
                weights["content"] += size
    return weights


def _judge(text: str, boilerplate: set[int], share: float) -> str | None:
    whole = [fold(x) for x in re.split(r"\r\n|\r|\n", text)]
    some = [i for i, x in enumerate(whole) if x.strip()]
    kept = [whole[i] for i in some if i not in boilerplate] or [whole[i] for i in some]
    if any(has_slot(x) and not _LOG.match(x) for x in kept):
        return "placeholder"
    weights = signs([_bare(x) for x in kept])
    total = sum(weights.values())
    kind = max(("error", "script", "filler"), key=weights.__getitem__)
    found = total - weights["content"]
    return kind if found and found >= share * total else None


def evidence(text: str, boilerplate: set[int]) -> str | None:
    """The kind of evidence in a text without its boilerplate lines (all of it if nothing else is left), or nothing."""
    return _judge(text, boilerplate, PAGE_SHARE)


def suspect(text: str) -> bool:
    """Whether a text has any evidence at all, however little of it; no subtraction of lines can bring more."""
    return _judge(text, set(), 0.0) is not None


def _host(url: Column, source: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.lower(F.when(host != "", host).otherwise(F.coalesce(source, F.lit(""))))


_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " "


def _lines(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., position, line): a row for each line that has any character, in a form that ignores numbers and ids."""
    line = F.lower(F.translate("raw", _WIDE, _NARROW))
    line = F.regexp_replace(F.regexp_replace(line, "[0-9a-f]{6,}|[0-9]+", "0"), r"\s+", " ")
    split = df.select(*keep, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("position", "raw")).withColumn("line", F.trim(line))
    return split.filter("line <> ''").select(*keep, "position", F.xxhash64("line").alias("line"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """(host, line): the lines that recur in texts of one host; counted over all records, copies once."""
    texts = docs.select("host", "text").withColumn("copy", F.xxhash64("text"))
    lines = _lines(texts, "host", "copy").select("host", "line", "copy").distinct()
    sizes = texts.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= RECURS_IN)
    return counts.join(sizes, "host").filter(F.col("n") >= F.col("texts") * RECURS_SHARE).select("host", "line")


def residue(df: DataFrame, key: str, text: str, url: str, source: str) -> DataFrame:
    """(key, kind) of every record whose residual shows that it has no real content."""
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), _host(F.col(url), F.col(source)).alias("host")).filter("doc IS NOT NULL AND text IS NOT NULL AND text <> ''")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([suspect(x) for x in batch["text"].to_pylist()], pa.bool_()))

    found = materialize(docs.select("doc", "host", "text").mapInArrow(sift, "doc bigint, host string, text string"))
    own = _lines(found, "doc", "host")
    recurrent = salted_lookup(own, boilerplate(docs), ["host", "line"], [F.col("doc")], "left_semi").groupBy("doc").agg(F.collect_list("position").alias("recurrent"))
    judged = found.select("doc", "text").join(recurrent, "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, e) for d, t, r in zip(*(batch[c].to_pylist() for c in ("doc", "text", "recurrent")), strict=True) if (e := evidence(t, set(r or ())))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([e for _, e in found])], ["doc", "kind"])

    return judged.mapInArrow(run, "doc bigint, kind string").select(F.col("doc").alias(key), "kind")
