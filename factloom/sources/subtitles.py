"""Subtitle bodies (JSON, VTT, SRT) as tables of cues, with Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"^(?:(\d{1,2}):)?(\d{2}):(\d{2})[,.](\d{1,3})$"
JSON_BODY = "struct<body: array<map<string, string>>>"


def milliseconds(stamp: Column) -> Column:
    """[HH:]MM:SS.mmm or with a comma, as milliseconds; null where it is malformed."""
    text = F.trim(stamp)
    part = lambda i: F.regexp_extract(text, STAMP, i)
    number = lambda i: F.coalesce(part(i).try_cast("bigint"), F.lit(0))
    value = (number(1) * 3600 + number(2) * 60 + number(3)) * 1000 + F.rpad(part(4), 3, "0").try_cast("bigint")
    return F.when(F.regexp_like(text, F.lit(STAMP)) & (number(2) < 60) & (number(3) < 60), value)


def text_cues(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, start_ms, end_ms, text) of VTT and SRT bodies; a block without a valid timing line has null times."""
    clean = F.regexp_replace(body, "﻿", "")
    blocks = files.select(key, F.posexplode(F.split(clean, r"\r?\n\s*\r?\n")).alias("position", "block"))
    lines = F.filter(F.transform(F.split("block", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.withColumn("lines", lines).where("size(lines) > 0").where("NOT upper(lines[0]) RLIKE '^(WEBVTT$|NOTE|STYLE|REGION)'")
    rows = rows.withColumn("at", F.expr("array_position(transform(lines, l -> contains(l, '-->')), true)"))
    timing = F.expr("IF(at > 0, lines[CAST(at AS INT) - 1], NULL)")
    start = milliseconds(F.regexp_extract(timing, r"^(.*?)-->", 1))
    end = milliseconds(F.regexp_extract(timing, r"-->\s*(\S+)", 1))
    said = F.when(F.col("at") > 0, F.array_join(F.expr("slice(lines, CAST(at AS INT) + 1, size(lines))"), "\n"))
    return rows.select(key, "position", start.alias("start_ms"), end.alias("end_ms"), said.alias("text"))


def json_cues(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, start_ms, end_ms, text) of JSON bodies; seconds are rounded to milliseconds half to even."""
    cues = files.select(key, F.posexplode(F.from_json(body, JSON_BODY)["body"]).alias("position", "cue"))
    seconds = lambda a, b: F.bround(F.coalesce(F.col("cue")[a], F.col("cue")[b]).try_cast("double") * 1000).cast("bigint")
    return cues.select(key, "position", seconds("from", "start").alias("start_ms"), seconds("to", "end").alias("end_ms"), F.coalesce(F.col("cue")["content"], F.col("cue")["text"], F.lit("")).alias("text"))


def chinese_track(tracks: DataFrame, video: str, language: str, source: str, position: str) -> DataFrame:
    """(video, position, reason): the preferred track of each video, or the reason asr_required without one."""
    lang = F.replace(F.lower(language), F.lit("_"), F.lit("-"))
    exact = lang.isin("zh-hans", "zh-cn")
    rank = F.when(F.startswith(lang, F.lit("zh")) & F.col(source).isin("official", "automatic"), F.when(F.col(source) == "official", 0).otherwise(2) + F.when(exact, 0).otherwise(1))
    best = tracks.groupBy(video).agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col(position).alias("position")))).alias("b"))
    names = F.array(*map(F.lit, ("manual_zh_hans_or_zh_cn", "manual_other_chinese", "automatic_zh_hans_or_zh_cn", "automatic_other_chinese")))
    return best.select(video, F.col("b.position").alias(position), F.coalesce(F.try_element_at(names, F.col("b.rank") + 1), F.lit("asr_required")).alias("reason"))


def ordered_cues(cues: DataFrame, key: str, start: str, end: str, position: str) -> DataFrame:
    """cues with `valid`: not empty, not before 0, and not before the end of the one before."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(position))
    return cues.withColumn("valid", F.coalesce((F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(start) >= F.coalesce(before, F.lit(0))), F.lit(False)))
