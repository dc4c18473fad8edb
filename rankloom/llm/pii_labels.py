"""The small labelled table from which the tagger of personal information is trained.

Everything here is general Japanese: common surnames and given names, official names of documents, usual notations of
numbers and addresses, and short everyday sentences with typed slots.  ``labelled_table`` fills the slots by a seeded
generator; half of the names are made of the name parts given, half of other names, common ones or characters put
together at random.  Ideographs for words without meaning come from the first level of the public character standard by
rule.  Sentences without slots of a labelled kind teach what is no personal information.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

KINDS = ("email", "phone", "id_number", "address", "name")

HONORIFICS = ("さん", "様", "氏", "先生", "殿", "くん", "君", "ちゃん", "さま", "部長", "課長", "教授", "社長", "店長")

# Common surnames and given names with their readings.
SURNAMES = """
佐藤さとう 鈴木すずき 高橋たかはし 田中たなか 伊藤いとう 渡辺わたなべ 山本やまもと 中村なかむら 小林こばやし 加藤かとう 吉田よしだ 山田やまだ 佐々木ささき 山口やまぐち 松本まつもと
井上いのうえ 木村きむら 斎藤さいとう 清水しみず 山崎やまざき 阿部あべ 池田いけだ 橋本はしもと 石川いしかわ 山下やました 小川おがわ 石井いしい 長谷川はせがわ 後藤ごとう 岡田おかだ
近藤こんどう 前田まえだ 藤田ふじた 遠藤えんどう 青木あおき 坂本さかもと 村上むらかみ 太田おおた 金子かねこ 藤井ふじい 福田ふくだ 西村にしむら 三浦みうら 竹内たけうち 中川なかがわ
岡本おかもと 松田まつだ 原田はらだ 中野なかの 小野おの 田村たむら 藤原ふじわら 中山なかやま 石田いしだ 小島こじま 和田わだ 森田もりた 内田うちだ 柴田しばた 酒井さかい 高木たかぎ
横山よこやま 安藤あんどう 宮崎みやざき 上田うえだ 島田しまだ 工藤くどう 大野おおの 宮本みやもと 杉山すぎやま 今井いまい 丸山まるやま 増田ますだ 村田むらた 平野ひらの 大塚おおつか
菅原すがわら 武田たけだ 新井あらい 野口のぐち 桜井さくらい 千葉ちば 岩崎いわさき 佐野さの 谷口たにぐち 上野うえの 松井まつい 河野こうの 市川いちかわ 野村のむら 菊地きくち 木下きのした
水野みずの 久保くぼ 五十嵐いがらし 西田にしだ 小池こいけ 大西おおにし 小松こまつ 吉川よしかわ 北村きたむら 安田やすだ 浜田はまだ 熊谷くまがい 本田ほんだ 早川はやかわ 森もり 林はやし 原はら 堀ほり 関せき 星ほし
""".split()  # fmt: skip
GIVEN_NAMES = """
健太けんた 翔太しょうた 大輔だいすけ 拓也たくや 直樹なおき 太郎たろう 一郎いちろう 次郎じろう 和也かずや 達也たつや 哲也てつや 雄太ゆうた 隆たかし 浩ひろし 誠まこと 学まなぶ 茂しげる 亮介りょうすけ
俊介しゅんすけ 幸雄ゆきお 正人まさと 信也しんや 秀樹ひでき 裕司ゆうじ 賢治けんじ 康平こうへい 大地だいち 蓮れん 陽斗はると 悠真ゆうま 花子はなこ 美咲みさき 陽子ようこ 恵子けいこ 由美ゆみ 愛あい
直美なおみ 久美子くみこ 幸子さちこ 和子かずこ 京子きょうこ 智子ともこ 裕子ゆうこ 真由美まゆみ 明美あけみ 麻衣まい 七海ななみ 千尋ちひろ 彩香あやか 結衣ゆい 優奈ゆうな 葵あおい 莉子りこ 舞まい
""".split()  # fmt: skip
#: Characters in which surnames and given names often end.
SURNAME_TAIL = "田村本山川原野井上口崎沢島木谷瀬藤橋浦塚岡森林屋見"
GIVEN_TAIL = "子美香奈恵太郎人介也樹斗司雄輝夫一平里紀実南"
KANA_SYLLABLES = "カキクケコサシスセソタチツテトナニネノハヒフヘホマミムメモヤユヨラリルレロワガギザジダデバビ"
ROMAJI_SYLLABLES = "ka ki ku ko sa shi su so ta chi to na ni no ha hi fu ma mi mo ya yu yo ra ri ru ro wa ga gi za ji da do".split()

# Places: prefectures and cities of Japan, usual names of quarters and of apartment houses.
PLACES = "札幌 函館 仙台 盛岡 秋田 山形 福島 水戸 高崎 川越 船橋 鎌倉 新潟 富山 金沢 長野 松本 静岡 浜松 岐阜 名古屋 京都 大阪 神戸 姫路 奈良 和歌山 鳥取 松江 岡山 倉敷 広島 下関 徳島 高松 松山 高知 博多 佐賀 長崎 熊本 別府 宮崎 鹿児島 那覇".split()
PREFECTURES = "宮城県 福島県 群馬県 千葉県 神奈川県 新潟県 長野県 静岡県 愛知県 滋賀県 京都府 大阪府 兵庫県 岡山県 広島県 香川県 福岡県 熊本県 東京都 北海道".split()
QUARTERS = "中央 本町 栄町 緑町 旭町 新町 東町 西町 元町 若葉台 桜木町 緑ヶ丘 北山 南大通 駅前 丸の内 大手町 寺町 浜町 みどり台 朝日町 泉台 上之町 美原".split()
HOUSES = "コーポ メゾン ハイツ レジデンス グリーンハイツ サンハイツ パークマンション 第一ビル 第二荘 ひまわり荘 グランド".split()
ROMAJI_PLACES = "Ginza Umeda Sakae Motomachi Kitayama Asahi Midori Honcho Nishiki Marunouchi".split()
PLACE_TAIL = "市 町 村 郡 駅 港 川 山 島 浜 坂 橋".split()

NOUNS = "会議 予定 写真 手帳 鞄 時計 椅子 机 冷蔵庫 自転車 郵便局 病院 図書館 学校 公園 海 橋 空港 飛行機 新幹線 切手 雑誌 新聞 映画 音楽 料理 野菜 果物 魚 米 紅茶 砂糖 傘 靴 上着 台風 地震 交通 経済 政治 文化 歴史 科学 技術 機械 装置 部品 試験 授業 宿題 論文 研究 実験 結果 建物 階段 廊下 電車 道路 信号 天候 気温 湖 森 花 犬 猫 鳥".split()
VERBS = "買って 売って 読んで 書いて 見て 聞いて 待って 送って 借りて 返して 直して 洗って 運んで 調べて 作って 選んで 比べて 探して".split()
ADJECTIVES = "大きい 小さい 新しい 古い 高い 安い 便利な 重要な 静かな 有名な 丈夫な 明るい".split()
PERSONS = "医師 作家 記者 店員 社員 学生 児童 警察官 農家 運転士 看護師 市長 画家 選手 弁護士 町民".split()
LOANWORDS = "センター カード データ ロボット デザイン グループ システム ニュース ビール カメラ エネルギー ツール バス ホテル テレビ ラジオ アプリ サービス ホーム Park NEXT Café Plus Pro 100 A棟 Lab".split()
LATIN = "Blue Ridge|Open Source|New York|Annual Report|Windows Update|Green Park|Version Two|User Guide|Red Line|Happy New Year|Tokyo Tower|Data Center".split("|")
DOMAINS = "example.com example.org example.net mail.example.jp post.example corp.example a-b.example.jp shop.test news-site.test mx1.example.net".split()

# Everyday words that hold an honorific's characters and name nobody.
NOBODY = """
神様 王様 殿様 仏様 お客様 皆様 皆さん お母さん お父さん お兄さん お姉さん おばあさん おじいさん 奥さん お嬢さん お医者さん 店員さん 大家さん 運転手さん 学生さん 隣の奥様 お子様 赤ちゃん
仕様 模様 様子 様式 異様 多様 同様 有様 様々 王様ペンギン 宮殿 神殿 御殿 沈殿 殿堂 殿下 君主 諸君 姫君 若君 主君 同氏 両氏 氏族 氏神 摂氏 華氏 先生方 先生 部長 課長 教授 社長 店長 先生役 部長会 教授会 たくさん さんざん ちゃんと さまざま
""".split()  # fmt: skip

CARRIERS = """
<email>
<phone>
<id>
<address>
<name>
メールアドレスは<email>です。
メール：<email>
E-mail: <email>
<email>へメールをください
資料は<email>あてに送ってください。
返信は<email>にお願いします
（<email>）
ご質問は<email>まで。
<prose>アドレスは<email>でした。
<prose><email>に書いて
電話：<phone>
TEL <phone>
お電話は<phone>まで
電話番号は<phone>です
携帯は<phone>で、
ご予約は<phone>へどうぞ。
（<phone>）
<phone>に電話して<prose>
<prose>連絡先：<phone>
<phone>まで折り返しお電話を
FAX：<phone>
<prose><phone>にかけ直し、
<id>を記入する
<id>です
<id>の写し
<prose><id>を届け出た
書類に<id>とあり
<id>を見せて<prose>
私の<id>です。
住所：<address>
住所は<address>です
現住所　<address>
<address>に住んでいます
<address>あてに荷物を出す
お届け先：<address>
会場は<address>にあります。
<prose><address>へ移転し
<prose>勤め先は<address>、
<address>で開業し<prose>
氏名：<anyname>
氏名：<anyname>、<prose>
お名前：<anyname>
お名前　<anyname>
<prose>名前は<anyname>です
<prose>氏名：<anyname>と
<known>が来た
<known>は<prose>
<known>と申します。
<prose><known>の話
<prose><known>に会い
担当は<known>です
昨年<known>が<prose>
<known>から手紙が
<known>、<known>
<named>に渡す
<named>が来ました
<named>から電話
<named>、こんにちは。
<named>へ
<named>
<named>
<named>
<named>
<named>と<named>が話し、
<prose><named>から借り、
<prose><named>のところで<prose>
<prose><named>に聞いた
担当の<named>が<prose>
担当<named>まで
隣は<named>です
<named>によると<prose>
<named>の<id>は
<named>、<phone>
<named>（<address>）
<known>（<email>）
<known>　<phone>
<address>　<named>
<email>か<phone>へ
<named>が<email>に<prose>
<prose><id>と<address>を
<prose><named>が<phone>で<prose>
<phone>、<prose><email>
<prose>
<prose>
<prose>
<prose><prose>
<decoy>
<decoy>
<prose><decoy>
<decoy><prose>
<word>
<word>
<word>
<word>
<kana>
"""

DECOYS = """
ご注文番号は<d12>です
注文番号：<d444h>
注文 No.<d12>
お荷物の伝票番号<d444h>
追跡番号は<d444s>となります
請求書番号 <d12>
請求書<d10>の支払い
お問い合わせ番号：<d12>
問い合わせ<d444s>の回答
受付番号 <d8>
整理番号<d6>番
会員番号<d8>
製品番号：<d10>
商品番号<d3>-<d4>
型番は<l><l><d4>です
品番 <l><l><d7>
シリアル番号<l><l><d8>
バージョン<d1>.<d1>.<d2>
20<d2>年<n>月<n>日の
20<d2>-0<d1>-1<d1>に
20<d2>/0<d1>/2<d1> <d2>:<d2>
<d2>:<d2>に着く
<d1>,<d3>,<d3>円を払う
<d3>.<d2>メートル
<d2>.<d4>, 1<d2>.<d4>
全<d3>ページの<n>ページ
<n>-<n>で勝った
<n>丁目の信号を右へ
<n>番地を過ぎ
<n>号室が空き
〒の記号を書く
郵便番号の調べ方
<place>駅の北口
<place>市の広報
<place>町で育ち
<place>県の人口
<family>駅の改札で
<family>市の歴史
<family>町へ行く
<family>川の水
<family>行きの電車
<family>方面に進む
<family>の<noun>
<family>では<noun>が
<family>から<noun>を
<family>と<place>の間
<family>まで<n>分
@<romaji>をフォローする
@<family>に返信
電話番号を変更する
メールの書き方
アドレスを忘れた
@の読み方
住所変更の手続き
住所が変わり
氏名を書く欄
名前の由来
パスポートを申請する
免許証を忘れた
マイナンバーの制度
保険証を持って
<nobody>が<noun>を
<nobody>に<noun>を
<nobody>の<noun>
<nobody>と<noun>
<nobody>
<prose><nobody>は<prose>
<nobody>、<noun>
<k>様<k>という字
<k><k>様は<noun>の名で
<k><k>君とは何か
<k><k>氏の意味
<k>殿<k>を辞書で引く
様<k><k>の読み
<latin>
<latin>を使う
<prose><latin>の<noun>
<kana>と書く
<kana>・<kana>の<noun>
<person>が<noun>を<verb>
<loan>・<loan>
"""

PROSE = """
<noun>と<noun>を<verb>帰り、
<noun>を<verb>から<noun>を<verb>、
<adj><noun>が<place>にある。
<place>の<noun>は<adj>と<person>が言い、
<family>の<noun>は<adj>、
<family>で<noun>を<verb>いる<person>が、
<place>から<family>まで<noun>で行き、
<n>年前に<person>が<noun>を<verb>、
<n>人の<person>と<noun>を<verb>
<noun>が<n>個あり、
<adj><noun>より<adj><noun>を<verb>、
<noun>は<word>という<noun>だ。
<word>と書かれた<noun>を<verb>、
<word>は<noun>の一つで、
<person>は<noun>を<verb>、<noun>へ向かった。
もし<noun>が<adj>なら<noun>を<verb>、
図<n>の<noun>を参照し、
第<n>回の<noun>が<place>で開かれ、
この<noun>では<noun>を<verb>いない。
<noun>や<noun>、<noun>が<adj>ので
<person>によれば<noun>は<adj>
<family>と<family>で<noun>を<verb>、
"""

_KATA = str.maketrans("".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7))))
_HIRA = {v: k for k, v in _KATA.items()}
WIDE = str.maketrans({**{chr(0x21 + i): chr(0xFF01 + i) for i in range(94)}, "-": "－"})


@lru_cache(maxsize=1)
def ideographs() -> str:
    """The ideographs of the first level of the character standard, by rule."""
    codes = (bytes([0xA0 + row, 0xA0 + cell]) for row in range(16, 48) for cell in range(1, 95))
    return "".join(code.decode("euc_jp", "ignore") for code in codes)


@lru_cache(maxsize=1)
def _syllables() -> dict[str, str]:
    rows = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
    table = {kana: head + vowel for head, own in rows.items() for kana, vowel in zip(own, "aiueo", strict=True)}
    return table | {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n", "し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "づ": "zu", "ぢ": "ji"}


def romanize(kana: str) -> str:
    """Hepburn letters of a hiragana reading, without marks for long vowels."""
    out = ""
    for char in kana:
        if char in "ゃゅょ":
            head = out[:-1]
            out = head + ("" if head.endswith(("sh", "ch", "j")) else "y") + {"ゃ": "a", "ゅ": "u", "ょ": "o"}[char]
        elif char == "っ":
            out += "t"
        else:
            out += _syllables().get(char, "")
    return out.replace("ou", "o").replace("uu", "u")


def _common(words: list[str]) -> list[tuple[str, str, str]]:
    """(written, reading, letters) of words that are written with their reading behind."""
    parts = [re.fullmatch("([^ぁ-ゖ]+)([ぁ-ゖ]+)", word) for word in words]
    return [(m[1], m[2], romanize(m[2])) for m in parts]


class Maker:
    def __init__(self, parts: list[tuple[str, str, str, str]], seed: int) -> None:
        self.rng = random.Random(seed)
        self.surnames, self.given_names = _common(SURNAMES), _common(GIVEN_NAMES)
        self.family = [p[1:] for p in parts if p[0] == "family"] or self.surnames
        self.given = [p[1:] for p in parts if p[0] == "given"] or self.given_names

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def pick(self, chars: str, low: int, high: int) -> str:
        return "".join(self.rng.choice(chars) for _ in range(self.rng.randint(low, high)))

    def letters(self, low: int, high: int) -> str:
        return "".join(self.rng.choice(ROMAJI_SYLLABLES) for _ in range(self.rng.randint(low, high)))

    def person(self, known: bool) -> tuple[tuple[str, str, str], tuple[str, str, str]]:
        """Family and given name as (written, kana, letters): listed, common, or put together."""
        r = self.rng
        if known:
            return r.choice(self.family), r.choice(self.given)
        if r.random() < 0.3:
            return r.choice(self.surnames), r.choice(self.given_names)
        family = (self.pick(ideographs(), 1, 2 if r.random() < 0.3 else 1) + r.choice(SURNAME_TAIL), self.pick(KANA_SYLLABLES, 3, 5).translate(_HIRA), self.letters(2, 4))
        given = (r.choice(ideographs()) + (r.choice(GIVEN_TAIL) if r.random() < 0.6 else r.choice(ideographs())), self.pick(KANA_SYLLABLES, 2, 4).translate(_HIRA), self.letters(2, 3))
        return family, given

    def full(self, known: bool, form: float | None = None) -> str:
        r = self.rng
        form = r.random() if form is None else form
        family, given = self.person(known)
        if form < 0.62:
            return family[0] + r.choice(["", "", " ", "　"]) + given[0]
        if form < 0.8:
            a, b = family[1], given[1]
            if r.random() < 0.75:
                a, b = a.translate(_KATA), b.translate(_KATA)
            return a + r.choice(["・", " ", "　"]) + b
        a, b = family[2], given[2]
        a, b = a.capitalize() if r.random() < 0.7 else a.upper(), b.capitalize()
        return f"{b} {a}" if r.random() < 0.75 else f"{a} {b}"

    def email(self) -> str:
        r = self.rng
        family, given = self.person(r.random() < 0.5)
        a, b = family[2] or "a", given[2] or "b"
        local = r.choice([f"{a}.{b}", f"info.{a}", f"{b}{self.digits(2)}", f"{b}-{a}", f"{a}+{r.choice(['news', 'shop', 'web'])}", f"{b[0]}_{a}", f"{a}_{b}", a, f"{b}{a}", f"{b[0]}.{a}", f"{self.letters(2, 4)}{self.digits(1)}"])
        domain, form = r.choice(DOMAINS), r.random()
        if form < 0.08:
            text = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        elif form < 0.12:
            text = f"{local}{r.choice([' at ', ' (at) ', '(at)'])}{domain.replace('.', r.choice([' dot ', '(dot)']))}"
        elif form < 0.2:
            text = f"{local}{r.choice(['（アット）', '(アット)', '＠', '[アット]'])}{domain}"
        else:
            text = f"{local}@{domain}"
        if r.random() < 0.12:
            text = text.upper()
        return text.translate(WIDE) if form > 0.88 else text

    def phone(self) -> str:
        r = self.rng
        a, b, c = r.choice([("0" + r.choice("789") + "0", 4, 4), ("0" + r.choice("36"), 4, 4), ("0" + self.digits(2), 3, 4), ("0" + self.digits(3), 2, 4), ("0120", 3, 3)])
        b, c = self.digits(b), self.digits(c)
        text = r.choice(["{0}-{1}-{2}"] * 4 + ["{0}({1}){2}", "({0}){1}-{2}", "{0}{1}{2}", "{0}{1}{2}", "{0} {1} {2}", "{0} ー {1} ー {2}", "{0}ー{1}ー{2}", "+81 {3} {1} {2}", "+81-{3}-{1}-{2}", "{0}−{1}−{2}", "{0}（{1}）{2}", "{0}.{1}.{2}"]).format(a, b, c, a[1:])
        return text.translate(WIDE) if r.random() < 0.12 else text

    def id_number(self) -> list[tuple[str, str | None]]:
        r = self.rng
        twelve = r.choice([self.digits(12), self.digits(12), f"{self.digits(4)}-{self.digits(4)}-{self.digits(4)}", f"{self.digits(4)} {self.digits(4)} {self.digits(4)}"])
        letters = self.pick("ABCDEFGHJKLMNPRSTVWXYZ", 2, 2)
        label, value = r.choice([("マイナンバー", twelve), ("マイナンバー", twelve), ("個人番号", twelve), ("運転免許証番号", self.digits(12)), ("運転免許証の番号", self.digits(12)), ("免許証番号", self.digits(12)), ("免許証", self.digits(12)), ("旅券番号", letters + self.digits(7)), ("旅券", letters + self.digits(7)), ("パスポート番号", letters + self.digits(7)), ("パスポート", letters + self.digits(7)), ("在留カード番号", letters + self.digits(8) + self.pick("ABCDEFGHJKLMNPRSTVWXYZ", 2, 2)), ("在留カードの番号", letters + self.digits(8) + self.pick("ABCDEFGHJKLMNPRSTVWXYZ", 2, 2)), ("保険証番号", self.digits(8)), ("被保険者番号", self.digits(8)), ("健康保険証の記号", f"{self.digits(r.randint(4, 5))}番号{self.digits(r.randint(5, 6))}"), ("保険証 記号", f"{self.digits(r.randint(4, 5))} 番号 {self.digits(r.randint(5, 6))}")])
        before, after = r.choice([("は", ""), ("は", ""), ("：", ""), (": ", ""), (" ", ""), ("　", ""), ("", ""), ("（", "）"), (" 第", "号"), ("が", "")])
        return [(label + before, None), (value.translate(WIDE) if r.random() < 0.15 else value, "id_number"), (after, None)]

    def address(self) -> str:
        r, n = self.rng, lambda: str(self.rng.randint(1, 40))
        if r.random() < 0.16:
            return f"{n()}-{n()}-{n()} {r.choice(ROMAJI_PLACES)}{r.choice(['-cho', '', '-machi'])}, {r.choice([r.choice(self.family)[2].capitalize(), self.letters(2, 4).capitalize()])}{r.choice(['-shi', '-ku', ' City'])}, {r.choice(['Japan', 'JAPAN', 'Tokyo'])}"
        place = lambda: r.choice([r.choice(PLACES), r.choice(self.family)[0], self.pick(ideographs(), 2, 2)])
        town = r.choice(["{0}市", "{1}{0}市", "{0}県{2}市", "{0}府{2}市", "{0}郡{2}町", "{0}県{2}郡{3}町", "{0}区", "{0}市{2}区", "{0}市大字{2}"]).format(place(), r.choice(PREFECTURES), place(), place())
        town += r.choice([r.choice(QUARTERS), self.pick(ideographs(), 2, 2) + r.choice("町台通坂丘"), r.choice(QUARTERS)])
        dash, kanji = r.choice("-−－‐"), r.choice("一二三四五六七八九")
        block = r.choice([f"{n()}丁目{n()}番{n()}号", f"{n()}丁目{n()}{dash}{n()}", f"{n()}{dash}{n()}{dash}{n()}", f"{n()}{dash}{n()}{dash}{n()}", f"{n()}{dash}{n()}", f"{n()}番地の{n()}", f"{n()}番地", f"{n()}番{n()}号", f"{kanji}丁目{n()}番地", f"{kanji}丁目{n()}番{n()}号"])
        room = r.choice(["", "", "", f"{r.choice([' ', '　'])}{r.choice(HOUSES)}{r.choice(['', self.pick(ideographs(), 1, 2)])}{self.digits(3)}{r.choice(['号室', '号', ''])}"])
        text = r.choice(["", "", f"〒{self.digits(3)}-{self.digits(4)} ", f"〒{self.digits(3)}-{self.digits(4)}　"]) + town + block + room
        return text.translate(WIDE) if r.random() < 0.1 else text

    def named(self) -> list[tuple[str, str | None]]:
        """A name that an honorific or a title marks."""
        r = self.rng
        known = r.random() < 0.5
        if r.random() < 0.12:
            name = self.full(known, 0.9) if r.random() < 0.7 else self.person(known)[0][2].capitalize()
            return [(r.choice(["Mr. ", "Ms. ", "Mrs. ", "Dr. ", "Mr "]), None), (name, "name")]
        name = self.full(known) if r.random() < 0.5 else self.person(known)[0][r.choice([0, 0, 0, 0, 0, 0, 1])]
        return [(name, "name"), (r.choice(HONORIFICS[:7] * 3 + HONORIFICS), None)]

    def fill(self, slot: str) -> list[tuple[str, str | None]]:
        """Pieces of text with their kind."""
        if slot == "email":
            return [(self.email(), "email")]
        if slot == "phone":
            return [(self.phone(), "phone")]
        if slot == "id":
            return self.id_number()
        if slot == "address":
            return [(self.address(), "address")]
        if slot in ("name", "known"):
            return [(self.full(True), "name")]
        if slot == "anyname":
            return [(self.full(self.rng.random() < 0.5), "name")]
        if slot == "named":
            return self.named()
        return [(self.plain(slot), None)]

    def word(self) -> str:
        """A word without meaning: ideographs, at times with a character that is an honorific elsewhere, or a loanword."""
        r = self.rng
        chars = [r.choice(ideographs()) for _ in range(r.choice([2, 2, 3, 3, 3, 4]))]
        if r.random() < 0.3:
            chars[r.randrange(len(chars))] = r.choice("様君氏殿長")
        if r.random() < 0.15:
            chars[-1] = r.choice("様君氏殿")
        return "".join(chars) + (r.choice(["", " "]) + r.choice(LOANWORDS) if r.random() < 0.3 else "")

    def plain(self, slot: str) -> str:
        r = self.rng
        lists = {"noun": NOUNS, "verb": VERBS, "adj": ADJECTIVES, "person": PERSONS, "loan": LOANWORDS, "latin": LATIN, "nobody": NOBODY}
        if slot in lists:
            return r.choice(lists[slot])
        if slot == "prose":
            text = self.expand(r.choice(PROSE.split("\n")[1:-1]))
            return text[r.randint(0, 6) :] if r.random() < 0.3 else text[: r.randint(5, 30)] + "、" if r.random() < 0.2 else text
        if slot == "decoy":
            return self.expand(r.choice(DECOYS.split("\n")[1:-1]))
        if slot == "n":
            return str(r.randint(1, 99))
        if slot == "place":
            return r.choice([r.choice(PLACES), r.choice(SURNAMES)[:1] + r.choice(SURNAME_TAIL), r.choice(ideographs()) + r.choice(SURNAME_TAIL), r.choice(ideographs()) + "ヶ丘"])
        if slot == "family":
            return r.choice(self.family)[0]
        if slot == "romaji":
            return self.person(r.random() < 0.5)[r.randint(0, 1)][2]
        if slot == "word":
            return self.word()
        if slot == "k":
            return r.choice(ideographs())
        if slot == "l":
            return r.choice("ABCDEFGHJKLMNPRSTVWXYZ")
        if slot == "kana":
            word = (r.choice(self.given)[1].translate(_KATA) if r.random() < 0.4 else "") + self.pick(KANA_SYLLABLES + "ンウイャュ", 3, 8)
            return word if r.random() < 0.6 else word.translate(_HIRA)
        if slot == "d444s":
            return f"{self.digits(4)} {self.digits(4)} {self.digits(4)}"
        if slot == "d444h":
            return f"{self.digits(4)}-{self.digits(4)}-{self.digits(4)}"
        return self.digits(int(slot[1:]))

    def expand(self, sentence: str) -> str:
        return re.sub(r"<(\w+)>", lambda m: self.plain(m[1]), sentence)


def labelled_table(parts: list[tuple[str, str, str, str]], rows: int = 6000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) from name parts (kind, written, kana, romaji); the same on every run."""
    maker, carriers = Maker(parts, seed), CARRIERS.split("\n")[1:-1]
    table = []
    for i in range(rows):
        text, spans = "", []
        for piece in re.split(r"(<\w+>)", carriers[i % len(carriers)]):
            for value, kind in maker.fill(piece[1:-1]) if piece.startswith("<") and piece.endswith(">") else [(piece, None)]:
                if kind and value:
                    spans.append((len(text), len(text) + len(value), kind))
                text += value
        table.append((text, spans))
    return table
