"""Stored intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuelight.plans.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the written copy: its lineage is cut, all its
    readers see the same rows, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for the intermediate tables of one job, of which those that are done with can be deleted."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, scratch_path(spark, label)

    def stored(self, df: DataFrame, label: str, **options) -> DataFrame:
        """As ``stored``, in this folder; a label is used once."""
        df.write.options(**options).parquet(f"{self.folder}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{label}")

    def discard(self, *labels: str) -> None:
        """Delete tables that nothing reads any more; without labels, all of them."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()  # files of any store are reached by Spark's own access to it
        for label in labels or [""]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


def with_totals(rows: DataFrame, key: str, totals: dict[str, Column], share: int = 1000) -> DataFrame:
    """``rows``, a stored table, with ``totals`` over all rows of the same ``key`` (null: a key like any other).

    A key of more than one in ``share`` rows meets its totals by broadcast, of which there are fewer than ``share``; the
    others are joined, and none of them is large.
    """
    sums = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in totals.items()])
    least = rows.count() // share
    hot = sums.filter(F.col("_n") > least).select("_key", F.lit(True).alias("_hot"), *totals)
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left")
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(
        sums.filter(F.col("_n") <= least), F.col(key).eqNullSafe(F.col("_key")))
    return marked.filter("_hot").select(*rows.columns, *totals).unionByName(rest.select(*rows.columns, *totals))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
    ).first())


def components(edges: DataFrame, max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Rows ``(node, root)`` for the nodes of ``edges(a, b)``: root is the smallest node that links reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every step hangs neighbours on the smallest
    one they know, by a grouped minimum with partial aggregation and a join that can be split when a node has very
    many neighbours. Links with a null end, and links of a node to itself, say nothing.
    """
    def star(links: DataFrame, keep_larger: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if keep_larger else links
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        near = both.join(least, "a")
        if keep_larger:
            return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = near.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return near.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    scratch = scratch or Scratch(edges.sparkSession, "components")
    current = scratch.stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links0",
    )
    state = _state(current)
    for n in range(max_rounds):
        if state[0] == 0:
            break
        following = scratch.stored(star(star(current, True), False), f"links{n + 1}")
        reached = _state(following)
        scratch.discard(f"links{n}")
        current = following
        if reached == state:
            break
        state = reached
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
