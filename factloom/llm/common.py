"""Shared helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters, as Python's bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A folder is made only where none is set, and only in local mode: on a cluster executors would write to their own disks.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A copy of df in the session's shared checkpoint folder, without its lineage.

    Shuffle files are removed when the driver's JVM collects the plans that wrote them, so it is asked to before more are
    written; else the files of all rounds of a loop stay on the executors' disks.
    """
    shared_folder(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table in that folder: for many rows of few columns, a fraction of a checkpoint's size.

    Unlike a checkpoint it keeps no partitioning and stays until the folder is removed.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.sparkSession.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch. Whole texts are long: Spark's default of 10,000 rows is a great part of an executor's memory.
BATCH = 250


def small_batches(df: DataFrame) -> None:
    """Arrow batches of BATCH rows in df's session, unless the session sets a size of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, BATCH)


#: Keys that hot_join broadcasts at most. Of the others none has more than 1 / HOT of all rows.
HOT = 1000


def hot_join(rows: DataFrame, of: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined (inner) with of, one row a key, whose column count says how many rows of each key there are.

    The HOT keys with the most rows are broadcast, so their rows stay where they are; all others are joined by a shuffle.
    """
    hot = F.broadcast(of.orderBy(F.desc(count), key).limit(HOT))
    rest = rows.join(hot.select(key), key, "left_anti").join(of, key)
    return rows.join(hot, key).unionByName(rest)


#: Words of 64 bits in a sieve: at most 262,144 rows (4 MB of numbers) whatever the input.
SIEVE = 1 << 18


def sieve(values: DataFrame) -> DataFrame:
    """(word, bits): a Bloom filter of fixed size of the only column of values; it fills up as values grow, but never loses one."""
    hashed = values.select(F.xxhash64(values.columns[0]).alias("h"))
    return hashed.selectExpr(f"pmod(h, {SIEVE}) AS word", "shiftleft(1L, CAST(pmod(shiftright(h, 24), 64) AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))


def sifted(rows: DataFrame, value: str, bits: DataFrame) -> DataFrame:
    """rows with a boolean column maybe: false only where value is not among those of the sieve. Its size is bounded, so it is broadcast."""
    h = F.xxhash64(value)
    hashed = rows.withColumn("word", F.pmod(h, F.lit(SIEVE))).withColumn("bit", F.expr(f"shiftleft(1L, CAST(pmod(shiftright(xxhash64({value}), 24), 64) AS INT))"))
    return hashed.join(F.broadcast(bits), "word", "left").withColumn("maybe", F.coalesce(F.expr("bits & bit <> 0"), F.lit(False))).drop("word", "bit", "bits")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Edges that connected links in one task: 4 MB. Shuffles of so few rows would cost more than they do.
FEW = 250_000


def connected(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges with the smallest node it can reach.

    Large-star and small-star rounds (Kiveris et al. 2014) until nothing changes. Each round relinks nodes by a
    minimum (pre-aggregated before the shuffle) and a join with one row a node, which AQE splits where a hub is large.
    Rounds grow with the logarithm of the nodes; `rounds` only stops a loop that cannot end. FEW edges or less are put
    into one partition, where the same rounds need no shuffle.
    """
    links = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    if not links.select("u").offset(FEW).head(1):
        links = cut(links.coalesce(1))
    state = None
    for _ in range(rounds):
        both = links.unionAll(links.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionAll(down.selectExpr("u", "m AS v")).distinct()
        links = cut(small)
        new = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(xxhash64(v, u) AS decimal(20, 0))"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return links.selectExpr("u AS node", "v AS root").unionAll(links.selectExpr("v AS node", "v AS root").distinct())
