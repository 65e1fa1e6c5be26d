"""Calendar periods from labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(label: Column) -> tuple[Column, Column]:
    """(first day, last day) of a day, month, quarter, half-year or year; nulls for any other label."""
    text = F.trim(label)
    part = lambda pattern, group: F.regexp_extract(text, pattern, group).try_cast("int")
    day = F.try_to_date(text, "yyyy-MM-dd")
    month, half = r"^(\d{4})(?:-|年)(\d{1,2})月?$", r"^(\d{4})\s*([QH])([1-4])$"
    letter, n, year = F.regexp_extract(text, half, 2), part(half, 3), part(half, 1)
    span = F.when(letter == "Q", 3).when(letter == "H", 6)
    first = F.make_date(year, n * span - span + 1, F.lit(1))
    in_range = n * span <= 12
    alone = part(r"^(\d{4})年?$", 1)
    m = part(month, 2)
    month_start = F.when(m.between(1, 12), F.make_date(part(month, 1), m, F.lit(1)))
    start = F.coalesce(day, month_start, F.when(in_range, first), F.make_date(alone, F.lit(1), F.lit(1)))
    end = F.coalesce(day, F.last_day(month_start), F.when(in_range, F.last_day(F.add_months(first, span - 1))), F.make_date(alone, F.lit(12), F.lit(31)))
    return start, end


def clamped(at: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(at, low), high)


CHINESE_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4}


def resolve(label: Column, base: Column) -> Column:
    """Struct (start_date, end_date, kind) of a period label or an expression relative to the day `base`.

    TTM and LTM reach 365 days back and NTM 365 days on; YTD ends on the base day; labels that name no time are UNRESOLVED.
    """
    text = F.regexp_replace(F.trim(label), r"(?U)\s+", "")
    start, end = period(F.regexp_replace(text, r"^(?i)cy(\d{4})$", "$1"))
    year = F.year(base)
    group = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    own = r"^(?:今年|本年|当年)?第?([一二三四1-4])季度$"
    dated = r"^(\d{4})年第?([一二三四1-4])季度$"
    number = lambda c: F.coalesce(c.try_cast("int"), *[F.when(c == k, v) for k, v in CHINESE_DIGITS.items()])
    q_year = F.coalesce(group(dated, 1).try_cast("int"), F.when(group(own, 1).isNotNull(), year))
    q = number(F.coalesce(group(dated, 2), group(own, 1)))
    q_start = F.make_date(q_year, q * 3 - 2, F.lit(1))
    day = F.try_to_date(F.regexp_replace(text, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", "$1-$2-$3"), "y-M-d")
    shift = F.when(text.isin("今天", "今日"), 0).when(text.isin("昨天", "昨日"), -1).when(text.isin("明天", "明日"), 1)
    rolling = F.upper(text)
    said = lambda s, e, kind: F.struct(s.alias("start_date"), e.alias("end_date"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("date")
    return (
        F.when(F.lower(text).isin("timeless", "无时间限定", "无时间性", "永恒", "永久"), said(none, none, "TIMELESS"))
        .when(start.isNotNull(), said(start, end, "PERIOD"))
        .when(day.isNotNull(), said(day, day, "DAY"))
        .when(q_start.isNotNull(), said(q_start, F.last_day(F.add_months(q_start, 2)), "QUARTER"))
        .when(rolling == "YTD", said(F.make_date(year, F.lit(1), F.lit(1)), base, "ROLLING"))
        .when(rolling.isin("TTM", "LTM"), said(F.date_sub(base, 365), base, "ROLLING"))
        .when(rolling == "NTM", said(base, F.date_add(base, 365), "ROLLING"))
        .when(shift.isNotNull(), said(F.date_add(base, shift), F.date_add(base, shift), "DAY"))
        .otherwise(said(none, none, "UNRESOLVED"))
    )
