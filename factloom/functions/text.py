"""Text functions as column expressions: clean-up, splitting, classification by first matching term, extraction, redaction.

Everything here is built from Spark's own functions and stays in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term lists in their order of precedence, and patterns.
BULLISH = ("增长", "利好", "上涨", "增持", "突破", "改善", "bullish")
BEARISH = ("下跌", "利空", "风险", "减持", "恶化", "bearish")
KIND_TERMS = {
    "CATALYST": ("催化", "订单", "政策利好", "涨价"),
    "RISK": ("风险", "下滑", "减持", "处罚"),
    "VALUATION": ("估值", "市盈率", "pe", "pb"),
    "EARNINGS": ("营收", "利润", "业绩", "毛利率"),
}
EVENT_TERMS = {
    "指引": "GUIDANCE", "业绩": "EARNINGS", "营收": "EARNINGS", "净利润": "EARNINGS", "订单": "ORDER_CONTRACT", "合同": "ORDER_CONTRACT", "扩产": "CAPACITY",
    "发布": "PRODUCT_LAUNCH", "政策": "POLICY_REGULATION", "监管": "POLICY_REGULATION", "收购": "M_AND_A", "回购": "BUYBACK", "减持": "SHAREHOLDER_CHANGE", "风险": "RISK",
}
PREDICATE_TERMS = {"支撑": "support_level", "压力": "resistance_level", "阻力": "resistance_level", "减仓": "reduce_position", "加仓": "increase_position"}
BOUNDARY_MARKERS = ("接下来", "下面", "再看", "然后看", "最后", "总结一下", "第二个", "第三个")
PII = (("CN_NATIONAL_ID", r"(?<!\d)\d{17}[\dXx](?!\d)"), ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("CN_MOBILE", r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)"))
BEARER = r"(?i)\bbearer\s+\S+"
ASSIGNMENT = r"(?i)\b(token|sig(?:nature)?|x-amz-(?:signature|credential)|authorization|cookie|key)=[^\s&]+"
SENTENCE_END = r"(?<=[。！？!?；;])\s*"
TICKER = r"(?<!\d)(\d{6})(?!\d)"
HARD_FACT = (
    r"(?:\d+(?:\.\d+)?%|(?:人民币|美元|港元|CNY|USD|HKD|¥|\$)\s?\d+(?:\.\d+)?(?:亿(?:元)?|万(?:元)?|千(?:元)?|元)?"
    r"|\d+(?:\.\d+)?(?:亿(?:元)?|万(?:元)?|千(?:元)?|元)|(?:20\d{2}\s*[Qq][1-4]|[Qq][1-4]\s*20\d{2})"
    r"|(?:[A-Z]{1,5}|\d{6})(?:\.[A-Z]{2})?)"
)


def collapsed(text: Column) -> Column:
    """White space of any kind as single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def sentences(text: Column) -> Column:
    """Parts after each sentence end."""
    return F.split(text, SENTENCE_END)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def first_term(text: Column, terms: dict[str, str], default: str | Column | None = None) -> Column:
    """The value of the first term, in declared order, that the text contains."""
    out = None
    for term, value in terms.items():
        hit = F.contains(text, F.lit(term))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def kind(text: Column, kinds: dict[str, Sequence[str]] = KIND_TERMS, default: str = "CLAIM") -> Column:
    """The first kind of which any term occurs in the lower-cased text."""
    low, out = F.lower(text), None
    for name, terms in kinds.items():
        hit = contains_any(low, terms)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def sentiment(text: Column, up: Sequence[str] = BULLISH, down: Sequence[str] = BEARISH) -> Column:
    """By the number of distinct terms of either side."""
    low = F.lower(text)
    n = sum((F.contains(low, F.lit(t)).cast("int") for t in up), F.lit(0)) - sum((F.contains(low, F.lit(t)).cast("int") for t in down), F.lit(0))
    return F.when(n > 0, "BULLISH").when(n < 0, "BEARISH").otherwise("NEUTRAL")


def title(text: Column, length: int = 28) -> Column:
    return F.substring(F.trim(collapsed(text), F.lit("，。,. ")), 1, length)


def ticker(text: Column) -> Column:
    """First isolated run of six digits; null without one."""
    return F.nullif(F.regexp_extract(text, TICKER, 1), F.lit(""))


def redacted_pii(text: Column) -> tuple[Column, Column]:
    """(text, kinds): identifiers replaced one pattern after another; a kind counts if it is found after the earlier ones are gone."""
    found = []
    for name, pattern in PII:
        found.append(F.when(F.regexp_like(text, F.lit(pattern)), F.lit(name)))
        text = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
    return text, F.array_compact(F.array(*found))


def redacted_credentials(text: Column) -> Column:
    """A URL loses query and fragment; other text loses bearer tokens and key=value credentials."""
    url = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+[^?#]*)", 1)
    other = F.regexp_replace(F.regexp_replace(text, BEARER, "Bearer <redacted>"), ASSIGNMENT, "$1=<redacted>")
    return F.when(url != "", url).otherwise(other)


def public_url(url: Column) -> Column:
    """https pages without user info, less query and fragment; null for all others."""
    clean = F.trim(url)
    page = F.regexp_extract(clean, r"^(https://[^/?#@\s]+[^?#]*)", 1)
    return F.when(F.regexp_like(clean, F.lit(r"^https://[^/?#@\s]+([/?#]|$)")), page)


def hard_facts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HARD_FACT), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, plus all others."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.ceil((F.length(text) - other) / 4) + other).cast("long")


def bigrams(text: Column) -> Column:
    """Distinct pairs of adjacent characters that are not blank."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(pairs, lambda p: F.trim(p) != "")))


def bigram_overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's bigrams that occur in the source; 1 for a claim without any."""
    own = bigrams(claim)
    hit = F.size(F.filter(own, lambda p: F.contains(source, p)))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(hit / F.size(own))


def drm(playlist: Column) -> Column:
    """Encryption declared by the key lines of an HLS playlist, the first decisive line counting."""
    keys = F.filter(F.transform(F.split(playlist, r"\r\n|\n|\r"), lambda x: F.upper(F.trim(x))), lambda x: F.startswith(x, F.lit("#EXT-X-KEY")))
    kinds = F.transform(keys, lambda x: F.when(F.contains(x, F.lit("METHOD=NONE")), "NONE").when(F.contains(x, F.lit("METHOD=AES-128")), "AES_128").when(F.contains(x, F.lit("METHOD=SAMPLE-AES")), "SAMPLE_AES").otherwise("UNKNOWN_ENCRYPTED"))
    return F.coalesce(F.try_element_at(F.filter(kinds, lambda k: k != "NONE"), F.lit(1)), F.lit("NONE"))


# Cues that call for a look at the picture, and fallback themes.
CUES = {
    "NUMERIC": r"(?<![A-Za-z0-9])\d+(?:,\d{3})*(?:\.\d+)?(?![A-Za-z0-9])",
    "UNIT": r"\d+(?:\.\d+)?\s*(?:%|％|亿元|万亿元|万元|万|亿|倍|个|台|吨|美元|人民币|USD|CNY)",
    "DATE": r"(?:19|20)\d{2}(?:年|[-/.])(?:0?[1-9]|1[0-2])(?:月|[-/.])?(?:0?[1-9]|[12]\d|3[01])?",
    "TICKER": r"(?<!\d)\d{6}(?!\d)",
    "COMPANY": r"[一-鿿A-Za-z]{2,16}(?:股份有限公司|有限公司|集团|银行|证券|科技|控股)",
    "PRODUCT": r"(?:产品|型号|芯片|GPU|CPU|服务器|软件|平台|版本)",
    "INDUSTRY": r"(?:行业|板块|赛道|产业链|金融|算力|半导体|银行业)",
    "CHART": r"(?:K线|走势图|曲线|图表|成交量|均线|支撑位|压力位)",
    "POLICY_DOCUMENT": r"(?:政策|文件|通知|公告|规划|条例|意见|增资|降准)",
    "TARGET_CUE": r"(?:关注|關注|上游|设备|設備|弹性|彈性)",
}
THEMES = ("黄金", "半导体", "AI", "消费", "券商", "银行", "新能源", "医药")
TOKEN = r"(?<!\w)(?:\d+(?:[.,]\d+)?%?|[A-Z]{1,6}(?:[.][A-Z]{1,4})?)(?!\w)"


def cues(text: Column) -> Column:
    """Names of the cues in a text, in their order."""
    return F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(k)) for k, p in CUES.items()]))


def themes(text: Column, known: Sequence[str] = ()) -> Column:
    """Known themes in the text, then fallback ones."""
    return F.filter(F.array_distinct(F.array(*map(F.lit, (*known, *THEMES)))), lambda t: F.contains(text, t))


def ungrounded(conclusion: Column, evidence: Column) -> Column:
    """Numbers and symbols of a conclusion that its evidence lacks."""
    return F.filter(F.array_distinct(F.regexp_extract_all(conclusion, F.lit(TOKEN), F.lit(0))), lambda t: ~F.contains(evidence, t))


def corrections(raw: Column) -> Column:
    """What white-space normalisation changed: one record, or none."""
    clean = collapsed(raw)
    record = F.struct(F.lit("WHITESPACE_NORMALIZATION").alias("type"), raw.alias("before"), clean.alias("after"))
    return F.when(raw != clean, F.array(record)).otherwise(F.array().cast("array<struct<type: string, before: string, after: string>>"))
