"""Tables, settled intermediates and checked broadcasts for the operators of this package."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import prepare, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` below the cluster's shared folder, densely compressed, and read it back.

    The lineage ends there and rows keep the numbers they were given, also when an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Groups into which exchanged keys are dealt: the shuffle partitions chosen for the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``max_rows``, otherwise unchanged."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one edge down, or edges up only: then ``v`` is the component's least vertex."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where(
        (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))
    return bad.agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: bigint) as rows (v, root), root being the least vertex.

    Large-star and small-star rounds: in turn every vertex hands its larger neighbours, then its smaller ones, to the
    least vertex near it. The edges of each round are settled; the number of rounds grows with the logarithm of the
    size. Vertices that are their own root are listed too. A vertex with very many edges is met in salted parts.
    """
    salts = F.explode(F.array([F.lit(i) for i in range(8)])).alias("part")

    def least(edges: DataFrame, low: DataFrame) -> DataFrame:
        parted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(8)).cast("int"))
        return parted.join(low.select("u", "low", salts), ["u", "part"]).drop("part")

    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = least(large, low).select(F.greatest("v", "low").alias("u"), F.col("low").alias("v")).union(
            low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        now = settle(small, "edges")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(
        now.select("v", F.col("v").alias("root")).distinct())


def map_batches(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots and backticks included; ``run`` sees the names as they are."""
    names = df.columns
    sent = [f"c{i}" for i in range(len(schema))]

    def renamed(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(sent)

    fields = [StructField(s, f.dataType, True) for s, f in zip(sent, schema.fields, strict=True)]
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, StructType(fields)).toDF(*schema.names)
