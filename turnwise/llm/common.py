"""Shared Spark helpers: scratch tables, connected components, the next key in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local master, whose tasks share its disk, may name none: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder, which cut the lineage and outlive executors. drop() frees those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/turnwise-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        was = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")  # the written table replaces the shuffle files
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(_CLEAN, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(tmp: Scratch, links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id reachable from each id that has a link. Ids are of any type that has an order.

    Rounds of hooking each node to its smallest neighbour, shortening the pointers until they reach roots, and contracting the
    links to roots. A round at least halves the nodes that still have links, so the rounds are logarithmic in the longest path.
    Null ids and links of a node to itself are left out; no links give an empty table.
    """
    none = links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    links = tmp.table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a"))
        hook = tmp.table(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")))
        while True:
            up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
            jumped = tmp.table(hook.join(up, "to", "left").select("id", F.coalesce("top", "to").alias("to"), (F.col("top") < F.col("to")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            tmp.drop(hook)
            hook = jumped.select("id", "to")
            tmp.paths[id(hook)] = tmp.paths.pop(id(jumped))
            if not moved:
                break
        step = hook.select(F.col("id").alias("component"), "to")
        if roots is None:
            joined = hook.select("id", F.col("to").alias("component"))
        else:
            joined = roots.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        new_roots = tmp.table(joined)
        new_links = tmp.table(
            links.join(hook.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a")
            .join(hook.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        tmp.drop(links, hook, *([] if roots is None else [roots]))
        links, roots = new_links, new_roots
    tmp.drop(links)
    return tmp.table(none) if roots is None else roots


def join_hot(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", least: int = 2_000, counted: DataFrame | None = None, counts: DataFrame | None = None, grown: bool = False) -> DataFrame:
    """big joined with small, which has one row at most for each key, where a few keys may hold most rows of big.

    A key with over `least` rows, and over a ten-thousandth of all rows, is dealt to several tasks by a hash of `spread`. So there
    are at most 10,000 such keys, which are broadcast; keys are counted with partial counts, in `counted` if that
    holds the same rows at less cost, or taken from `counts`, which has a row and its number `_n` for each key that can meet. Null keys meet nothing.
    Spark broadcasts either side where it takes it for small; `grown` says that big is larger than Spark can know, as after an explode.
    """
    counted = big if counted is None else counted
    if counts is None:
        counts = counted.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        total = counted.count()
    else:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    per = max(least, total // 10_000)
    hot = counts.where(F.col("_n") > per).select(*on, F.ceil(F.col("_n") / per).cast("int").alias("_salts")).collect()  # at most 10,000 rows
    if not hot:
        return (big.hint("merge") if grown else big).join(small, on, how)
    hot = F.broadcast(big.sparkSession.createDataFrame([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in hot], big.select(*on).schema.add("_salts", T.IntegerType())))
    salted = big.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return (salted.hint("merge") if grown else salted).join(copies, [*on, "_salt"], how).drop("_salt")


def successors(tmp: Scratch, keys: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """keys(doc_id, h, ...) without repeats, each with `next`, a struct of the row that follows by doc_id and h; the last is followed by the first.

    Keys go to as many ranges as they need and are ordered in each; only the first key of each range, one in rows_per_range, is
    ordered in one task. Null ids come first. A single key is followed by itself.
    """
    keys = tmp.table(keys)
    by, row = [F.col("doc_id").asc_nulls_first(), F.col("h")], F.struct(*keys.columns)
    ranged = tmp.table(keys.repartitionByRange(-(-keys.count() // rows_per_range) or 1, *by).withColumn("r", F.spark_partition_id()))
    heads = ranged.groupBy("r").agg(F.min_by(row, F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("head"))
    over = Window.orderBy("r")
    after = heads.select("r", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("beyond"))
    follows = ranged.withColumn("next", F.lead(row).over(Window.partitionBy("r").orderBy(*by)))
    return tmp.table(follows.join(after, "r").select(*keys.columns, F.coalesce("next", "beyond").alias("next")))
