"""The rules of detection, as data. A rule is a pattern with a score, and what must hold for its matches.

In Java patterns ``\\p{Nd}`` stands for digits of all scripts and WS for all white space, where a rule means these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.spans import SPAN, around, each, has_any, hits, keep, let, lit, mof_valid, none, pieces, shortest, span, words_near

WS = r"[\s\p{Z}\x1c-\x1f\x85]"
N = r"\p{Nd}"


@dataclass(frozen=True)
class Soft:
    """How words around a match raise its score: one of a rule's soft words among the ``before`` words ahead of it or the
    ``after`` words behind it adds ``boost``, to ``floor`` at least and 1 at most."""

    before: int = 5
    after: int = 0
    boost: float = 0.35
    floor: float = 0.4

    def best(self, score: float) -> float:
        """The score with a soft word."""
        return min(1.0, max(self.floor, round(score + self.boost, 6)))


@dataclass(frozen=True)
class Facts:
    """Names of what several rules ask of a text, each found once: seven digits in a row, three of them, the text in lower case."""

    eight: str
    four: str
    low: str


@dataclass(frozen=True)
class Rule:
    """One pattern of an entity type.

    keywords: one of them must stand within 50 characters of the match. check: a condition on the matched value.
    hint: a cheap condition on the whole text without which the pattern cannot match. soft: words that raise the score
    if they stand near (``Soft``). Conditions are SQL text.
    """

    entity: str
    name: str
    pattern: str
    score: float
    group: int = 0
    keywords: tuple[str, ...] = ()
    check: Callable[[str], str] | None = None
    hint: Callable[[str, Facts], str] | None = None
    soft: tuple[str, ...] = field(default=())

    def best(self, soft: Soft | None) -> float:
        """The highest score that a match can have."""
        return soft.best(self.score) if soft and self.soft else self.score

    def when(self, text: str, facts: Facts) -> str | None:
        """What must hold for the whole text."""
        parts = [self.hint(text, facts)] if self.hint else []
        return " AND ".join([*parts, *([has_any(text, self.keywords)] if self.keywords else [])]) or None


def _words(words: tuple[str, ...]) -> str:
    return f"array({', '.join(map(lit, shortest(words)))})" if words else none("string")


def rule_spans(rules: tuple[Rule, ...], text: str, facts: Facts, soft: Soft | None = None, threshold: float = 0.0) -> str:
    """Spans of all rules in a text, of at least ``threshold``: patterns give hits, which then meet a table of the rules by number."""
    if not rules:
        return none(SPAN)
    found = hits(text, [(r.pattern, r.group, r.when(text, facts)) for r in rules])
    checks = " ".join(f"WHEN {i} THEN {r.check('h.value')}" for i, r in enumerate(rules) if r.check)
    if checks:
        found = f"filter({found}, h -> CASE h.r {checks} ELSE true END)"
    softs = [r.soft if soft else () for r in rules]
    rows = [f"named_struct('entity', {lit(r.entity)}, 'score', {r.score}D, 'best', {r.best(soft)}D, 'keywords', {_words(r.keywords)}, 'soft', {_words(tuple(w.lower() for w in s))})" for r, s in zip(rules, softs)]

    def near(window: str, words: str) -> str:
        return let(window, lambda w: f"exists({words}, k -> contains({w}, k))")

    def scored(rules_: str, hits_: str, parts: str) -> str:
        out = hits_
        if any(r.keywords for r in rules):
            out = keep(out, lambda h: f"size({rules_}[{h}.r].keywords) = 0 OR {near(around(parts, h), f'{rules_}[{h}.r].keywords')}")
        score = lambda h: f"{rules_}[{h}.r].score"
        if any(softs):
            score = lambda h: f"CASE WHEN size({rules_}[{h}.r].soft) > 0 AND {near(words_near(parts, h, soft.before, soft.after), f'{rules_}[{h}.r].soft')} THEN {rules_}[{h}.r].best ELSE {rules_}[{h}.r].score END"
        out = each(out, lambda h: span(f"{rules_}[{h}.r].entity", f"{h}.start", f"{h}.end", score(h)))
        return keep(out, lambda s: f"{s}.score >= {threshold}D") if any(r.score < threshold for r in rules) else out

    def placed(hits_: str) -> str:
        some = let(f"array({', '.join(rows)})", lambda t: let(pieces(text), lambda parts: scored(t, hits_, parts)))
        return f"CASE WHEN size({hits_}) > 0 THEN {some} ELSE {none(SPAN)} END"

    return let(found, placed)


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[- ]', '')"


def _not_a_card(value: str) -> str:
    return f"NOT (length({value}) >= 13 AND luhn_check({value}))"


def _luhn(value: str) -> str:
    return f"luhn_check({_digits(value)})"


def _mof(value: str) -> str:
    return f"({value} rlike '^[0-9]{{8}}$' AND {mof_valid(value)})"


def _eight(text: str, facts: Facts) -> str:
    return facts.eight


def _four(text: str, facts: Facts) -> str:
    return facts.four


def _says(*words: str) -> Callable[[str, Facts], str]:
    """Any of the words in the lower-cased text."""
    return lambda text, facts: has_any(facts.low, words)


def _contains(*words: str) -> Callable[[str, Facts], str]:
    return lambda text, facts: has_any(text, words)


# Patterns, scores and word lists that results depend on.
PLATE_WORDS = ("車牌", "牌照", "車號", "車輛", "汽車", "機車", "行照", "號牌", "車籍", "車")
BIRTH_WORDS = ("生日", "出生", "出生日期", "出生年月日", "出生日", "DOB", "birthday", "生日期", "出生年", "年齡")
BANK_WORDS = ("帳號", "帳戶", "存摺", "銀行", "轉帳", "匯款", "戶號", "銀行帳戶", "銀行帳號", "帳", "存款", "金融帳號")
BUSINESS_WORDS = ("統一編號", "統編", "公司", "廠商", "發票", "稅籍", "法人", "營業", "企業", "行號", "商號")
SEED_WORDS = ("助記詞", "助记词", "種子詞", "种子词", "seed phrase", "mnemonic", "recovery phrase")
RULES: list[Rule] = [
    Rule("TW_NATIONAL_ID", "national id", rf"(?<![A-Za-z0-9])[A-Z][12]{N}{{8}}(?![A-Za-z0-9])", 0.9, soft=("身分證", "身份證", "證號", "國民身分證", "身分證字號", "ID"), hint=_eight),
    Rule("TW_ARC", "resident certificate", rf"(?<![A-Za-z0-9])[A-Z][A-D89]{N}{{8}}(?![A-Za-z0-9])", 0.85, soft=("居留證", "外僑居留證", "外籍居留證", "ARC", "外籍", "居留"), hint=_eight),
    Rule("TW_PASSPORT", "passport", rf"(?<![A-Za-z0-9])[A-Z]{N}{{8}}(?![A-Za-z0-9])", 0.6, soft=("護照", "passport", "護照號碼", "護照號", "出入境"), hint=_eight),
    Rule("TW_MOBILE", "mobile", rf"(?<!{N})09{N}{{8}}(?!{N})", 0.9, soft=("手機", "行動電話", "手機號碼", "行動", "mobile", "cell"), hint=_eight),
    Rule("TW_MOBILE", "mobile in groups", rf"(?<!{N})09{N}{{2}}(?:-|{WS}){N}{{3}}(?:-|{WS}){N}{{3}}(?!{N})", 0.9, hint=_four),
    Rule("TW_MOBILE", "mobile abroad", rf"\+886(?:-|{WS})?9{N}{{2}}(?:-|{WS})?{N}{{3}}(?:-|{WS})?{N}{{3}}", 0.9, hint=_contains("+886"), soft=("手機", "電話", "mobile", "phone", "聯絡", "聯繫", "行動電話")),
    Rule("TW_LANDLINE", "landline", rf"(?<!{N})0[2-8]{N}{{7,8}}(?!{N})", 0.7, soft=("電話", "市話", "辦公室", "公司電話", "聯絡電話", "分機", "phone", "tel"), hint=_eight),
    Rule("TW_LANDLINE", "landline in brackets", rf"\(0[2-8]\){WS}*{N}{{4}}(?:-|{WS})?{N}{{4}}", 0.85, hint=_contains("(0")),
    Rule("TW_LANDLINE", "landline with hyphen", rf"(?<!{N})0[2-8]-{N}{{7,8}}(?!{N})", 0.85, hint=_eight),
    Rule("TW_BUSINESS_ID", "business number", rf"(?<!{N}){N}{{8}}(?!{N})", 0.85, keywords=BUSINESS_WORDS, check=_mof, hint=_eight),
    # any maximal address, also before a full stop or a digit; \G: right after another one
    Rule("EMAIL_ADDRESS", "e-mail", r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0.85, hint=_contains("@"), soft=("信箱", "電郵", "email", "e-mail", "郵件", "寄信")),
    Rule("CREDIT_CARD", "card", r"(?<!\d)(?!1\d{12}(?!\d))(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{3,4}[- ]?\d{3,4}[- ]?\d{3,5}(?!\d)", 1.0, check=_luhn, hint=_four),
    Rule("TW_LICENSE_PLATE", "plate", r"(?<![A-Za-z0-9])[A-Z]{2,3}-[0-9]{4}(?![A-Za-z0-9])", 0.85, keywords=PLATE_WORDS),
    Rule("TW_LICENSE_PLATE", "plate, number first", r"(?<![0-9])[0-9]{3,4}-[A-Z]{2}(?![A-Za-z0-9])", 0.85, keywords=PLATE_WORDS),
    Rule("TW_BIRTH_DATE", "date of the republic", rf"民國{WS}?{N}{{2,3}}{WS}?年{WS}?{N}{{1,2}}{WS}?月{WS}?{N}{{1,2}}{WS}?日", 0.9, hint=_contains("民國")),
    Rule("TW_BIRTH_DATE", "western date", rf"(?<!{N}){N}{{4}}[-/.]{N}{{1,2}}[-/.]{N}{{1,2}}(?!{N})", 0.85, keywords=BIRTH_WORDS, hint=_four),
    Rule("TW_BANK_ACCOUNT", "account", r"(?<![0-9])[0-9]{12,16}(?![0-9])", 0.85, keywords=BANK_WORDS, check=_not_a_card, hint=_eight),
    Rule("TW_VERIFICATION_CODE", "code", rf"(?i)(?:驗證碼|認證碼|動態密碼|一次性密碼|verification{WS}*code|otp|one[- ]?time{WS}*password){WS}*[:：]?{WS}*([A-Za-z0-9]{{4,8}})(?![\p{{L}}\p{{N}}_])", 0.8, group=1, hint=_says("驗證碼", "認證碼", "動態密碼", "一次性密碼", "verification", "otp", "password")),
    Rule("TW_PASSWORD", "password", rf"(?i)(?:密碼|密码|password|pwd|pass){WS}*(?:是|為|为)?{WS}*[:：]?{WS}*([A-Za-z0-9!@#$%^&*_\-+=.]{{4,32}})", 0.75, group=1, hint=_says("密碼", "密码", "pwd", "pass")),
    Rule("TW_CRYPTO_SEED", "seed phrase", r"(?i)(?:[a-z]{3,8}[ \t]+){11,23}[a-z]{3,8}", 0.8, keywords=SEED_WORDS),
    Rule("TW_PRIVATE_KEY", "private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", 0.95, hint=_contains("PRIVATE KEY")),
]
NAMED = ("PERSON", "ORG", "LOCATION")
ENTITIES = (*NAMED, "TW_ADDRESS", *dict.fromkeys(r.entity for r in RULES))
# Names that reports show.
DISPLAY_NAMES = {
    "TW_NATIONAL_ID": "身分證字號", "TW_ARC": "居留證", "TW_MOBILE": "手機號碼", "TW_LANDLINE": "市話", "TW_BUSINESS_ID": "統一編號", "EMAIL_ADDRESS": "Email",
    "CREDIT_CARD": "信用卡", "TW_PASSPORT": "護照", "TW_LICENSE_PLATE": "車牌", "TW_BIRTH_DATE": "出生日期", "TW_BANK_ACCOUNT": "銀行帳號",
}
# What addresses are made of.
BOUNDARY = "縣市鄉鎮區路街道號巷弄樓層室房棟幢座館段"
_PLACE = f"(?:(?![{BOUNDARY}])[一-鿿0-9])"
TIERS: list[tuple[int, str]] = [
    (9, "(?:台|臺)(?:北|中|南|東)市|新北市|桃園市|高雄市|基隆市|新竹市|嘉義市|新竹縣|苗栗縣|彰化縣|南投縣|雲林縣|嘉義縣|屏東縣|宜蘭縣|花蓮縣|(?:台|臺)東縣|澎湖縣|金門縣|連江縣"),
    (8, f"{_PLACE}{{1,3}}(?:鄉|鎮|區)"),
    (7, f"{_PLACE}{{1,6}}(?:路|街|道|大道)(?:[一二三四五六七八九十]+段)?"),
    (6, rf"{N}+(?:巷|弄)"),
    (5, rf"{N}+(?:之{N}+)?號"),
    (4, f"{_PLACE}{{1,6}}(?:大樓|大廈|社區|中心|廣場|園區)"),
    (3, "[A-Za-z0-9]{0,2}(?:棟|幢|座|館)"),
    (2, rf"{N}+(?:樓|層)|[Ff]{N}+"),
    (1, rf"{N}+(?:室|房)|第?[一二三四五六七八九十\p{{Nd}}]+單元"),
]
#: Characters of which each token of a tier has one: a text without them is not searched for it.
TIER_SIGNS = {9: "[市縣]", 8: "[鄉鎮區]", 7: "[路街道]", 6: "[巷弄]", 5: "號", 4: "[樓廈區心場]", 3: "[棟幢座館]", 2: "[樓層Ff]", 1: "[室房元]"}
ADDRESS_SCORE, ADDRESS_GAP, ADDRESS_JOINTS = 0.85, 4, rf"^(?:{WS}|[,，、])*$"
