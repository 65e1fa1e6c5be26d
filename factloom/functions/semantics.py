"""Column expressions that class statements and time expressions by fixed words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import contains_any

# Words that results must agree on.
DOMAIN_TERMS = {
    "FINANCIAL_SECTOR_CAPITAL_POLICY": ("资本补充", "银行资本", "银行", "保险"),
    "AI_INFERENCE_COMPUTE": ("ai推理", "推理算力", "gpu", "算力", "芯片"),
    "INFORMATION_INFRASTRUCTURE_POLICY": ("信息基础设施", "基础设施投资", "信息基建"),
    "CENTRAL_BANK_GOLD_RESERVES": ("黄金储备", "黄金", "央行储备"),
    "PORTFOLIO_RISK_MANAGEMENT": ("仓位", "资金池", "止损", "均线", "杠杆", "风险预算", "集中度"),
}
CAUSES = ("因为", "导致", "推动", "从而", "所以")
VIEWS = ("应当", "不要", "建议", "我认为", "看好", "看空")
FACTUAL = ("PRICE", "RETURN", "VALUATION", "FINANCIAL_METRIC", "CORPORATE_EVENT", "INDUSTRY_RELATION")
MECHANISMS = ("因为", "因此", "所以", "依赖", "关键条件", "卡住", "瓶颈", "约束")
IMPLICATIONS = ("意味着", "有望", "可能", "受益", "反弹", "业绩")
UP = ("增长", "上涨", "上升", "提升", "提高", "增加", "走高")
DOWN = ("下降", "下跌", "下滑", "降低", "减少", "回落", "走低")
DIGITS = ("一二两三四五六七八九零", "12234567890")
SESSIONS = {"PREMARKET": ("盘前", "pre-market", "premarket"), "AFTERHOURS": ("盘后", "after-hours", "afterhours"), "AUCTION": ("集合竞价", "auction"), "CLOSED": ("闭市", "休市", "closed"), "REGULAR": ("收盘", "开盘", "盘中", "regular")}
ASSERTIONS = {"REVISED": ("下修", "上修", "修订", "修正", "改到", "revised"), "PLANNED": ("计划", "拟", "planned"), "EXPECTED": ("预计", "预期", "expected", "estimate")}


def first_class(text: Column, classes: dict[str, Sequence[str]], default: str | None = None) -> Column:
    """Name of the first class with a word in the text."""
    out = None
    for name, words in classes.items():
        out = F.when(contains_any(text, words), name) if out is None else out.when(contains_any(text, words), name)
    return out.otherwise(F.lit(default))


def domain(text: Column) -> Column:
    return first_class(F.lower(text), DOMAIN_TERMS, "UNKNOWN")


def nature(claim_type: Column, text: Column) -> Column:
    """FACT, FORECAST, OPINION, CAUSAL_THESIS or METHOD."""
    kind = F.upper(F.coalesce(claim_type, F.lit("")))
    return F.when(kind.isin("FORECAST", "OPINION"), kind).when((kind == "INFERENCE") & contains_any(text, CAUSES), "CAUSAL_THESIS").when((kind == "INFERENCE") | contains_any(text, VIEWS), "OPINION").when(kind.isin(*FACTUAL), "FACT").otherwise("METHOD")


def role(nature_: Column, text: Column) -> Column:
    """Part of a claim in an argument: MECHANISM, EVIDENCE or IMPLICATION."""
    said = F.upper(F.coalesce(nature_, F.lit("")))
    numeric = text.rlike(r"\d|价格|涨幅|预测值|图表")
    return F.when(contains_any(said, ("CAUSAL", "MECHANISM", "WORKFLOW")) | contains_any(text, MECHANISMS), "MECHANISM").when(F.contains(said, F.lit("FORECAST")), F.when(numeric, "EVIDENCE").otherwise("IMPLICATION")).when(contains_any(text, IMPLICATIONS), "IMPLICATION").otherwise("EVIDENCE")


def direction(text: Column) -> Column:
    """UP or DOWN by words, else by a signed number; null if neither."""
    return F.when(contains_any(text, UP), "UP").when(contains_any(text, DOWN), "DOWN").when(text.rlike(r"[+＋]\s*\d"), "UP").when(text.rlike(r"[-−－]\s*\d"), "DOWN")


def plain_digits(text: Column) -> Column:
    """Chinese digits as Arabic ones, without the words for per cent."""
    return F.replace(F.translate(text, *DIGITS), F.lit("百分之"), F.lit(""))


def market_session(text: Column) -> Column:
    return first_class(F.lower(text), SESSIONS)


def assertion(text: Column) -> Column:
    """REVISED, PLANNED or EXPECTED by its markers; null for a plain one."""
    return first_class(F.lower(F.regexp_replace(text, r"\s+", "")), ASSERTIONS)


def role_defaults(role_: Column, scope: Column) -> tuple[Column, Column]:
    """(scope, assertion) that a temporal role implies."""
    forecast, interval = role_ == "FORECAST_TARGET", role_.isin("CONDITION_PERIOD", "INVALIDATION_PERIOD")
    return F.when(forecast, "FORECAST").when(interval, "INTERVAL").otherwise(scope), F.when(forecast, "EXPECTED").otherwise("ACTUAL")


def open_start(text: Column) -> tuple[Column, Column]:
    """(start, label) of an expression that has only a beginning, such as a year or quarter onward; nulls for others."""
    pattern = r"(?i)^(?:(?:自|从)(\d{4})年?(?:Q([1-4]))?(?:起|开始|以来|onwards?)?|(?:since|from)\s+(\d{4})(?:-([1-4]))?)$"
    part = lambda a, b: F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in (a, b)]).cast("int")
    year, quarter = part(1, 3), part(2, 4)
    start = F.make_date(year, (F.coalesce(quarter, F.lit(1)) - 1) * 3 + 1, F.lit(1))
    return start, F.when(year.isNotNull(), F.coalesce(F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string")), F.concat(F.lit("CY"), year.cast("string"))))


def week_or_day(text: Column, anchor: Column) -> tuple[Column, Column]:
    """(start, end) of next week, this week (from Monday), tomorrow and today against the anchor day; nulls for others."""
    monday = F.to_date(F.date_trunc("week", anchor))
    start = F.when(F.contains(text, F.lit("下周")), F.date_add(monday, 7)).when(contains_any(text, ("本周", "这周")), monday).when(F.contains(text, F.lit("明天")), F.date_add(anchor, 1)).when(F.contains(text, F.lit("今天")), anchor)
    return start, F.when(contains_any(text, ("下周", "本周", "这周")), F.date_add(start, 6)).otherwise(start)


def reading_level(score: Column) -> Column:
    """HIGH from 0.95, MEDIUM from 0.85, else LOW; an unknown score is LOW."""
    return F.when(score >= 0.95, "HIGH").when(score >= 0.85, "MEDIUM").otherwise("LOW")
