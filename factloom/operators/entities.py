"""Named entities of texts: a dictionary of aliases of any size by automata, then codes and company names by patterns."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: built-in aliases, suffixes and fillers of company names, and what is no company
ALIASES = (
    ("上证指数", "INDEX", "000001.SH"), ("沪指", "INDEX", "000001.SH"), ("深证成指", "INDEX", "399001.SZ"), ("创业板", "INDEX", "399006.SZ"), ("恒生科技", "INDEX", "HSTECH"),
    ("黄金", "COMMODITY", "XAUUSD"), ("原油", "COMMODITY", "CL"), ("美联储", "MACRO", "FED"), ("半导体", "INDUSTRY", "SEMI"), ("AI", "THEME", "AI"),
)
SUFFIXES = "网络 科技 电子 通信 股份 集团 能源 电气 光电 信息 软件 医疗 药业 生物 材料 数通 电力 环境 制造 智控 智能 资本".split()
FILLERS = "这里 这页 这个 那个 主要 关于 在讲 讲的 看看 再看 比如 就是 一下 来看 说到 提到".split()
NO_COMPANIES = "交易信息 市场行情 行情 资讯 服务 前复权 后复权 不复权 日线 周线 月线 季线 年线 分时 分钟 现价 今开 涨跌 涨幅 总收入 净利润 总量 总额 总笔 市值 流通 换手 主力净额 闭市阶段".split()
NO_ENDINGS = "阶段 指标 策略 市场 行情 资讯 服务".split()
THEMES = ("FED", "SEMI", "AI")
COMPANY = r"([一-鿿]{2,4}(?:" + "|".join(SUFFIXES) + "))"
CODE_THEN_NAME, NAME_THEN_CODE = r"(?:[A-Z]{0,3})?(\d{6})\s*([一-鿿]{2,8})", r"([一-鿿]{2,8})\s*(?:\(|（)?(?:[A-Z]{0,3})?(\d{6})"
CODE = r"(?U)\b\d{6}\b|\b\d{4}\.(?i:HK)\b|\b[A-Za-z]{1,5}\b"

#: Names in one automaton: what a worker holds at a time, some hundred MB at most. A larger dictionary is matched in several passes.
CHUNK = 200_000


def alias_hits(texts: DataFrame, aliases: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """(key, ordinal): the aliases (name, ordinal) that each text holds, each once.

    Every chunk of the dictionary is broadcast and becomes one Aho-Corasick automaton a task, which reads a text once however
    many names there are. Empty names and null ones are never held, texts that are null hold none.
    """
    names = aliases.where("name <> ''").select("name", "ordinal")
    n = names.count()
    parts = max(1, -(-n // chunk))
    spark, found = texts.sparkSession, None
    for part in range(parts):
        mine = names if parts == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast([(r.name, r.ordinal) for r in mine.collect()])

        def match(batches, held=held):
            automaton = ahocorasick.Automaton()
            at: dict[str, list[int]] = {}
            for name, ordinal in held.value:
                at.setdefault(name, []).append(ordinal)
            for name in at:
                automaton.add_word(name, name)
            automaton.make_automaton()
            for b in batches:
                rows, hits = [], []
                for i, value in enumerate(b.column(1).to_pylist() if at else []):
                    for name in {name for _, name in automaton.iter(value)} if value else ():
                        rows.extend([i] * len(at[name]))
                        hits.extend(at[name])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(rows, np.int64))), pa.array(hits, pa.int64())], [key, "ordinal"])

        got = texts.select(key, text).mapInArrow(match, f"`{key}` {dict(texts.dtypes)[key]}, ordinal long")
        found = got if found is None else found.unionByName(got)
    return found


def company(name: Column) -> Column:
    """A name without the fillers before it, as long as two characters are left."""
    return F.regexp_replace(F.trim(name), "^(?:(?:" + "|".join(FILLERS) + ")(?=.{2}))+", "")


def likely_company(name: Column) -> Column:
    plain = F.regexp_replace(name, "[^一-鿿]", "")
    return F.length(plain).between(3, 8) & ~plain.isin(*NO_COMPANIES) & ~plain.rlike("(?:" + "|".join(NO_ENDINGS) + ")$")


def company_names(text: Column) -> Column:
    """Likely company names by their suffix, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(COMPANY), F.lit(1)), company), likely_company))


def code_name_pairs(text: Column) -> Column:
    """Pairs (ticker, name) of a code beside a likely company name: codes before names first, then names before codes; each once."""
    both = F.concat(*[F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(t)).alias("ticker"), F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(n)), company).alias("name")) for p, t, n in ((CODE_THEN_NAME, 1, 2), (NAME_THEN_CODE, 2, 1))])
    return F.array_distinct(F.filter(both, lambda p: likely_company(p["name"])))


def codes(text: Column) -> Column:
    """Six-digit codes, four-digit ones of Hong Kong and words of up to five letters, in upper case, each once; words of one or two letters are none."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), F.upper))
    return F.filter(found, lambda c: ~c.rlike("^[A-Z]{1,2}$"))


def code_kind(code: Column) -> Column:
    return F.when(code.rlike(r"^(\d{4}\.HK|\d{6})$"), "EQUITY").when(code.isin(*THEMES), "THEME").otherwise("UNKNOWN")


def extract(texts: DataFrame, aliases: DataFrame, key: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """(key, ordinal, name, ticker, entity_type): the entities of each text, numbered from 0 in the order in which they are found.

    Four passes, each of which leaves out what an earlier one, or itself, has seen: aliases (name, ticker, entity_type, ordinal) in
    the dictionary's order, one a ticker; codes beside company names, unless code or name is seen; codes alone; company names. The key
    is unique; texts that are null or hold nothing have no rows.
    """
    hits = alias_hits(texts, aliases, key, text, chunk).join(aliases.select("ordinal", "name", "ticker", "entity_type"), "ordinal")
    one = hits.groupBy(key, "ticker").agg(F.min(F.struct("ordinal", "name", "ticker", "entity_type")).alias("e"))
    named = one.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list("e")).alias("__named"))
    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).join(named, F.col(key) == F.col("__key"), "left")
    kind = "array<struct<name: string, ticker: string, entity_type: string>>"
    first = F.coalesce(F.transform("__named", lambda e: F.struct(e["name"].alias("name"), e["ticker"].alias("ticker"), e["entity_type"].alias("entity_type"))), F.array().cast(kind)).cast(kind)
    rows = rows.select(key, first.alias("__out"), F.coalesce(F.transform("__named", lambda e: e["ticker"]), F.array().cast("array<string>")).alias("__seen"), code_name_pairs(F.col("__text")).alias("__pairs"), codes(F.col("__text")).alias("__codes"), company_names(F.col("__text")).alias("__names"))
    start = F.struct(F.col("__seen").alias("seen"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        added = F.struct(F.concat(acc["seen"], F.array(p["ticker"], p["name"])).alias("seen"), F.concat(acc["out"], F.array(F.struct(p["name"].alias("name"), p["ticker"].alias("ticker"), F.lit("EQUITY").alias("entity_type")))).alias("out"))
        return F.when(F.array_contains(acc["seen"], p["ticker"]) | F.array_contains(acc["seen"], p["name"]), acc).otherwise(added)

    rows = rows.withColumn("__fold", F.aggregate("__pairs", start, step))
    rows = rows.withColumn("__codes", F.array_except("__codes", "__fold.seen")).withColumn("__names", F.array_except("__names", "__fold.seen"))
    alone = F.transform("__codes", lambda c: F.struct(c.alias("name"), c.alias("ticker"), code_kind(c).alias("entity_type")))
    last = F.transform("__names", lambda c: F.struct(c.alias("name"), c.alias("ticker"), F.lit("EQUITY").alias("entity_type")))
    every = F.concat("__out", "__fold.out", alone.cast(kind), last.cast(kind))
    return rows.select(key, F.posexplode(every).alias("ordinal", "e")).select(key, "ordinal", "e.*")
