"""Personal information in free text: a conditional random field over word-shape features.

Features of each character, all computed as numpy arrays over a whole batch: the characters around it, their classes,
the class and length of the run it stands in and of its neighbours, the shape of the number it belongs to
(``3-4-4``, ``4 4 4``), which name parts, honorifics and labels begin, end or lie there, and the last label before it
with its distance.  ``Tagger`` is trained on the table of ``pii_labels`` and decoded by Viterbi in batches.

Every text is read whole; a long one is tagged in pieces that overlap by ``MARGIN`` characters on both sides, further than
any feature but the last label reaches.  An exact check follows the decoding: a span must hold what its kind needs (an
email a domain, a phone nine to thirteen digits, ...).

Defined results: null and empty texts have no spans; repeated rows are tagged alike; length is unbounded; an empty table
of name parts only removes those features.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.crf import ROWS, Crf
from rankloom.llm.pii_labels import HONORIFICS, KINDS, labelled_table

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words that announce or belong to a kind of text.
CUES = {
    "email": "メール アドレス e-mail email mail:".split(),
    "phone": "電話 携帯 連絡先 tel ファクス ファックス fax 内線".split(),
    "id_number": "マイナンバー 個人番号 免許証 旅券 パスポート 在留カード 保険証 被保険者".split(),
    "order": "注文 請求 問い合わせ 伝票 追跡 受付番号 整理番号 会員番号 品番 型番 製品番号 商品番号 製造番号 シリアル バージョン".split(),
    "address": "住所 届け先 丁目 番地 号室 〒 所在地".split(),
    "name": "氏名 名前 担当 mr. ms. mrs. dr. mr ms".split(),
    "place": "県 府 市 郡 町 村 区 -cho -machi -shi -ku japan".split(),
}
FLAGS = {"family": 1, "given": 2, "family_kana": 4, "given_kana": 8, "family_romaji": 16, "given_romaji": 32, "honorific": 64}
#: Characters of a piece of a long text, those that neighbouring pieces share on each side, the farthest label that counts.
PIECE, MARGIN, REACH = 4000, 256, 64
#: Most name parts; the table of parts goes to every worker.
MOST_PARTS = 100_000

_NEWLINE, _DIGIT, _LOWER, _UPPER, _HIRA, _KATA, _KANJI, _SPACE, _DASH, _AT, _DOT, _PAREN, _PUNCT, _COLON, _OTHER, _LONG = range(16)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Width folding, lower case and class of each code point."""
    size = 0x110000
    folded = np.arange(size, dtype=np.uint32)
    folded[0xFF01 : 0xFF01 + 94] = np.arange(0x21, 0x21 + 94)
    folded[0x3000] = folded[0xA0] = 0x20
    for dash in "−‐‑–—―":
        folded[ord(dash)] = ord("-")
    lower = folded.copy()
    for code in range(ord("A"), ord("Z") + 1):
        lower[folded == code] = code + 32
    kind = np.full(size, _OTHER, np.uint8)
    kind[0x30:0x3A], kind[0x61:0x7B], kind[0x41:0x5B] = _DIGIT, _LOWER, _UPPER
    kind[0x3041:0x3097], kind[0x30A1:0x30FB], kind[0x4E00:0xA000] = _HIRA, _KATA, _KANJI
    kind[0x3005] = _KANJI
    for chars, value in ((" \t\r", _SPACE), ("-", _DASH), ("@", _AT), (".+_・", _DOT), ("()[]〔〕【】「」", _PAREN), ("、。,!?！？", _PUNCT), (":：", _COLON), ("ー", _LONG), ("\n", _NEWLINE)):
        for char in chars:
            kind[ord(char)] = value
    return folded, lower, kind[folded]


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    value = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
    for part in parts:
        value = (value ^ np.asarray(part, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        value = value ^ (value >> np.uint64(29))
    return (value & np.uint64(ROWS - 1)).astype(np.int32)


def _shift(values: np.ndarray, by: int) -> np.ndarray:
    """The value at position i + by; zero outside."""
    out = np.zeros_like(values)
    if by > 0:
        out[:-by] = values[by:]
    elif by < 0:
        out[-by:] = values[:by]
    else:
        out[:] = values
    return out


_CLUSTER = re.compile(r"[+(]?[0-9][0-9()\-ー. ]*[0-9]")


class Lexicon:
    """Name parts, honorifics and labels as one automaton over folded text."""

    def __init__(self, parts: list[tuple[str, str, str, str]]) -> None:
        self.parts = parts
        words: dict[str, list[tuple[str, int]]] = {}
        kata = str.maketrans("".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7))))
        for kind, written, kana, romaji in parts:
            for word, flag in ((written, kind), (kana, f"{kind}_kana"), ((kana or "").translate(kata), f"{kind}_kana"), (romaji, f"{kind}_romaji")):
                if word:
                    words.setdefault(word.lower(), []).append(("flag", FLAGS[flag]))
        for word in HONORIFICS:
            words.setdefault(word, []).append(("flag", FLAGS["honorific"]))
        for i, cues in enumerate(CUES.values(), 1):
            for word in cues:
                words.setdefault(word, []).append(("cue", i))
        self.automaton = ahocorasick.Automaton()
        for word, meanings in words.items():
            self.automaton.add_word(word, (len(word), meanings))
        self.automaton.make_automaton()


def features(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows, positions of the texts' characters in them, lengths) of a batch, by arrays over all its characters."""
    folded_of, lower_of, class_of = _tables()
    joined = "\n".join(x.replace("\n", " ") for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    char, kind = lower_of[codes].astype(np.uint64), class_of[codes].astype(np.uint64)
    size = len(codes)
    breaks = kind == _NEWLINE
    char[breaks] = 0
    lowered = lower_of[codes].tobytes().decode("utf-32-le", "surrogatepass")
    # Runs of one class.
    edge = np.concatenate([[True], kind[1:] != kind[:-1]])
    run = np.cumsum(edge) - 1
    run_start = np.flatnonzero(edge)
    run_length = np.diff(np.append(run_start, size))
    bucket = np.searchsorted([1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 13], run_length, side="right").astype(np.uint64)
    run_kind = kind[run_start]
    run_code = run_kind * np.uint64(16) + bucket
    own, before, before2, after, after2 = run_code[run], _shift(run_code, -1)[run], _shift(run_code, -2)[run], _shift(run_code, 1)[run], _shift(run_code, 2)[run]
    place = np.minimum(np.arange(size) - run_start[run], 3).astype(np.uint64) * np.uint64(4) + np.minimum(run_length[run] - 1 - (np.arange(size) - run_start[run]), 3).astype(np.uint64)
    # Shapes of numbers.
    shape = np.zeros(size, np.uint64)
    for m in _CLUSTER.finditer(lowered):
        text = m[0]
        if len(text) > 2:
            code = 0
            for piece in re.findall(r"[0-9]+|[^0-9]", text)[:9]:
                code = (code * 61 + (min(len(piece), 14) if piece[0].isdigit() else 15 + ord(piece[0]) % 45)) & 0xFFFFFFFFFFFF
            shape[m.start() : m.end()] = code + 1
    # Words of the lexicon.
    inside, begins, ends, cue, then = (np.zeros(size, np.uint64) for _ in range(5))
    letters = (kind == _LOWER) | (kind == _UPPER)
    for end, (length, meanings) in lexicon.automaton.iter(lowered):
        start = end + 1 - length
        if letters[start] and (start and letters[start - 1] or end + 1 < size and letters[end + 1]):
            continue
        for what, value in meanings:
            if what == "cue":
                cue[end] = value
            else:
                inside[start : end + 1] |= np.uint64(value)
                begins[start] |= np.uint64(value)
                ends[end] |= np.uint64(value)
                if value == FLAGS["honorific"]:  # what stands behind an honorific
                    then[start] = max(int(then[start]), (1 + int(kind[min(end + 1, size - 1)])) * 4 + min(length, 3))
    index = np.arange(size)
    text_start = np.maximum.accumulate(np.where(np.concatenate([[True], breaks[:-1]]), index, 0))
    cued = np.where((cue > 0) & (cue < 7), index, -1)
    last = np.maximum.accumulate(np.concatenate([[-1], cued[:-1]]))
    known = (last >= text_start) & (index - last <= REACH)
    last_kind = np.where(known, cue[np.maximum(last, 0)], 0).astype(np.uint64)
    last_far = np.searchsorted([1, 2, 4, 7, 12, 20], np.where(known, index - last, 99), side="right").astype(np.uint64)
    polite = np.where((begins & np.uint64(64)) > 0, index, size + 99)
    following = np.minimum.accumulate(np.concatenate([polite[1:], [size + 99]])[::-1])[::-1]
    polite_far = np.minimum(following - index, 9).astype(np.uint64)
    behind = np.where(following <= index + 8, then[np.minimum(following, size - 1)], 0).astype(np.uint64)
    left = (index == text_start).astype(np.uint64) + np.uint64(2) * _shift(breaks.astype(np.uint64), 1)
    k = {i: _shift(kind, i) for i in range(-3, 4)}
    c = {i: _shift(char, i) for i in range(-2, 3)}
    columns = [
        *(_mix(1 + i, c[i - 2]) for i in range(5)),
        _mix(6, c[-1], c[0]), _mix(7, c[0], c[1]),
        _mix(8, k[-1], k[0], k[1]), _mix(9, k[-2], k[-1], k[0]), _mix(10, k[0], k[1], k[2]), _mix(11, k[-3], k[-2], k[-1], k[0], k[1]), _mix(30, k[-1], k[0], k[1], k[2], k[3]),
        _mix(12, own, place), _mix(13, before, own), _mix(14, own, after), _mix(15, before, own, after), _mix(31, before2, before, own), _mix(32, own, after, after2),
        _mix(16, shape), _mix(17, shape, last_kind), _mix(18, last_kind, last_far, kind), _mix(19, last_kind, own),
        _mix(20, polite_far, kind), _mix(21, polite_far, k[-1], k[0]),
        _mix(22, inside, kind), _mix(23, _shift(inside, -1), inside), _mix(24, inside, _shift(inside, 1)), _mix(25, begins, ends), _mix(26, _shift(ends, -1), begins),
        _mix(27, _shift(ends, -2), _shift(kind, -1), begins), _mix(28, ends, _shift(begins, 1)), _mix(29, ends, _shift(kind, 1), _shift(begins, 2)),
        _mix(33, inside, last_kind, last_far), _mix(34, inside, polite_far), _mix(35, c[-1], last_kind, kind),
        _mix(36, behind, polite_far, kind), _mix(37, behind, k[-1], k[0], k[1]), _mix(38, behind, inside), _mix(39, behind, c[0]), _mix(40, left, own, polite_far), _mix(41, c[0], polite_far), _mix(42, own, place, polite_far, behind),
    ]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.stack(columns, 1), np.flatnonzero(_text_mask(lengths, size)), lengths


def _text_mask(lengths: np.ndarray, size: int) -> np.ndarray:
    mask = np.ones(size, bool)
    mask[np.cumsum(lengths + 1) - 1] = False
    return mask


def _digits(text: str) -> int:
    return sum(x.isdigit() for x in text)


def plausible(kind: str, text: str) -> bool:
    """The exact check of a decoded span."""
    text = unicodedata.normalize("NFKC", text)
    if kind == "email":
        return bool(re.search(r"\w\s*(?:[@＠]|[(（\[]\s*(?:at|アット)\s*[)）\]]|\sat\s)\s*[\w-]+\s*(?:[.．]|[(（\[]\s*(?:dot|ドット)\s*[)）\]])\s*\w", text, re.IGNORECASE))
    if kind == "phone":
        return 9 <= _digits(text) <= 13
    if kind == "id_number":
        return _digits(text) >= 6
    if kind == "address":
        return _digits(text) >= 1 or bool(re.search("[一二三四五六七八九十]丁目", text))
    return len(text.strip()) >= 2 and not _digits(text) and "@" not in text


def pieces(length: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last): overlapping pieces of a text and the range of starts that each one decides."""
    cuts = [*range(0, max(length - PIECE // 2, 1), PIECE), length]
    return [(max(a - MARGIN, 0), min(b + MARGIN, length), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


class Tagger:
    """The trained model with its lexicon; small enough to be sent to each worker once."""

    def __init__(self, parts: list[tuple[str, str, str, str]], rows: int = 6000, epochs: int = 8) -> None:
        self.lexicon = Lexicon(parts)
        table = labelled_table(parts, rows)
        matrix, at, lengths = features([text for text, _ in table], self.lexicon)
        gold, offset = np.zeros(int(lengths.sum()), np.int64), 0
        for text, spans in table:
            for start, end, kind in spans:
                number = 1 + 2 * KINDS.index(kind)
                gold[offset + start], gold[offset + start + 1 : offset + end] = number, number + 1
            offset += len(text)
        self.model = Crf(len(LABELS))
        self.model.fit(matrix[at], gold, lengths, epochs)
        for label in range(len(LABELS)):  # inside may only follow its own kind
            if label % 2 == 0 and label:
                self.model.moves[[x for x in range(len(LABELS) + 1) if x not in (label, label - 1)], label] = -1e4

    def __getstate__(self) -> dict:
        rows = np.flatnonzero(self.model.weights.any(1))
        return {"parts": self.lexicon.parts, "rows": rows.astype(np.int32), "weights": self.model.weights[rows], "moves": self.model.moves}

    def __setstate__(self, state: dict) -> None:
        self.lexicon, self.model = Lexicon(state["parts"]), Crf(len(LABELS))
        self.model.weights[state["rows"]], self.model.moves = state["weights"], state["moves"]

    def tag(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """[(start, end, kind)] for each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        todo = [(i, *piece) for i, x in enumerate(texts) if x for piece in pieces(len(x))]
        step, at = 60_000, 0
        while at < len(todo):  # batches of a bounded number of characters
            rows, total = [], 0
            while at < len(todo) and (not rows or total + todo[at][2] - todo[at][1] <= step):
                rows.append(todo[at])
                total += todo[at][2] - todo[at][1]
                at += 1
            parts = [texts[i][start:end] for i, start, end, _, _ in rows]
            matrix, positions, lengths = features(parts, self.lexicon)
            best = self.model.decode(self.model.emissions(matrix[positions]), lengths)
            bounds = np.cumsum(lengths)
            for owner in np.unique(np.searchsorted(bounds, np.flatnonzero(best), side="right")):
                i, start, _, first, last = rows[owner]
                own = best[int(bounds[owner] - lengths[owner]) : int(bounds[owner])]
                out[i] += [(start + a, start + b, kind) for a, b, kind in self._spans(parts[owner], own) if first <= start + a < last]
        return out

    def _spans(self, text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
        spans, start, kind = [], -1, ""
        for i, label in enumerate([*labels.tolist(), 0]):
            if start >= 0 and (label == 0 or label % 2 == 1 or KINDS[(label - 1) // 2] != kind):
                if plausible(kind, text[start:i]):
                    spans.append((start, i, kind))
                start = -1
            if label and start < 0:
                start, kind = i, KINDS[(label - 1) // 2]
        return spans


@lru_cache(maxsize=4)
def _trained(parts: tuple[tuple[str, str, str, str], ...]) -> Tagger:
    """Trained once in a driver for these name parts."""
    return Tagger(list(parts))


def tagger_bytes(parts: tuple[tuple[str, str, str, str], ...]) -> bytes:
    return pickle.dumps(_trained(parts))


@lru_cache(maxsize=2)
def _load(blob: bytes) -> Tagger:
    return pickle.loads(blob)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def name_parts(df: DataFrame) -> tuple[tuple[str, str, str, str], ...]:
    """The small fixed table of name parts on the driver; more than ``MOST_PARTS`` are refused."""
    parts = df.select("kind", "written", "kana", "romaji").filter("kind IN ('family', 'given') AND written IS NOT NULL").distinct()
    rows = sorted(parts.limit(MOST_PARTS + 1).collect(), key=lambda r: tuple(x or "" for x in r))
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    return tuple((r["kind"], r["written"], r["kana"] or "", r["romaji"] or "") for r in rows)


def _map(df: DataFrame, key: str, columns: list[str], tagger: bytes, schema: str, make) -> DataFrame:
    blob = df.sparkSession.sparkContext.broadcast(tagger)  # a few MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _load(blob.value)
        for batch in batches:
            keys, texts = batch[0].to_pylist(), [batch[i + 1].to_pylist() for i in range(len(columns))]
            spans = [tagger.tag(x) for x in texts]
            yield make(keys, texts, spans)

    return df.select(key, *columns).filter(F.col(key).isNotNull()).mapInArrow(run, schema)


def found_kinds(df: DataFrame, key: str, columns: list[str], tagger: bytes) -> DataFrame:
    """(key, field_name, kind): one row for each kind present in a field."""
    arrow = pa.schema([(key, pa.int64()), ("field_name", pa.string()), ("kind", pa.string())])

    def make(keys: list, texts: list, spans: list) -> pa.RecordBatch:
        rows = [(k, name, kind) for name, own in zip(columns, spans, strict=True) for k, s in zip(keys, own, strict=True) for kind in sorted({x[2] for x in s})]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow.types)], schema=arrow)

    return _map(df, key, columns, tagger, f"{key} bigint, field_name string, kind string", make)


def redacted(df: DataFrame, key: str, columns: list[str], tagger: bytes) -> DataFrame:
    """(key, columns...): the same texts with typed placeholders."""
    arrow = pa.schema([(key, pa.int64()), *((c, pa.string()) for c in columns)])

    def make(keys: list, texts: list, spans: list) -> pa.RecordBatch:
        cells = [[x if x is None else redact(x, s) for x, s in zip(own, found, strict=True)] for own, found in zip(texts, spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(x, pa.string()) for x in cells)], schema=arrow)

    return _map(df, key, columns, tagger, ", ".join([f"{key} bigint", *(f"{c} string" for c in columns)]), make)
