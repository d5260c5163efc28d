"""Alert feeds with Structured Streaming.

Stateless steps and watermarked aggregates are plain streaming frames. Steps that
carry state per host or per day run in ``foreachBatch`` on the batch operators, so
a host with a third of the feed is spread like in a batch; their state is a table
with one version per batch id, which makes a repeated batch write the same thing.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import canonical, features, rank
from ..functions import times
from ..session import exists, is_folder, remove, small_side

WATERMARK = "1 hour"
_COPIES = 200_000


def read_feed(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    """The files at ``path``, a folder or a single file, as they arrive."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if is_folder(spark, path):
        return reader.load(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).load(folder)


def canonical_stream(raw: DataFrame, mapping: dict[str, str | None] | None = None) -> DataFrame:
    """Canonical columns plus ``event_time``, the zoned twin that watermarks need."""
    return with_event_time(canonical.canonicalise(raw, mapping))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.col("timestamp").cast("timestamp"))


def _first_of_copies(batches):
    """Rows without the later ones of equal id and time in the same partition, as far as ``_COPIES`` ids remember."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(batch.column("event_id").to_pylist(), batch.column("event_time").cast("int64").to_pylist()))
        keep = []
        for key in keys:
            keep.append(key not in seen)
            seen.add(key)
        if len(seen) > _COPIES:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def dedup_stream(df: DataFrame, delay: str = WATERMARK, fold: bool = True) -> DataFrame:
    """First arrival per event id within the watermark; later rows than that are dropped.

    With ``fold`` copies that arrive together, with the same time, are first removed inside each partition, without
    state; so an id with very many copies does not send them all to one task. Copies of another time stay: the first may
    be too late while the second is not.
    """
    rows = df.mapInArrow(_first_of_copies, df.schema) if fold else df
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def monitor_stream(df: DataFrame, delay: str = WATERMARK, width: str = "1 hour",
                   selected: Column | None = None) -> DataFrame:
    """Rows, selected rows and mean score per time window and host."""
    score = F.col("anomaly_score") if "anomaly_score" in df.columns else F.lit(None).cast("double")
    picked = selected if selected is not None else F.lit(False)
    return df.withWatermark("event_time", delay).groupBy(F.window("event_time", width), "agent").agg(
        F.count("*").alias("alerts"), F.count_if(picked).alias("selected"), F.avg(score).alias("mean_score"))


class VersionedState:
    """A small table with one folder per batch id; batch n reads n-1 and writes n."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def at(self, batch_id: int) -> str:
        return f"{self.path}/v={batch_id}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        return None if batch_id == 0 else spark.read.parquet(self.at(batch_id - 1))

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Write version ``batch_id``; the two before stay for repeated batches, older ones go."""
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(self.at(batch_id))
        if batch_id > 2:
            remove(spark, self.at(batch_id - 3))
        return spark.read.parquet(self.at(batch_id))


def recency_step(state: VersionedState, sink: Callable[[DataFrame, int], None],
                 keys: tuple[str, ...] = features.HOST, expire: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: seconds since the host's previous alert, across batches.

    The state is the last time per key. The first alert ever of a key has NULL (the
    frozen median later); a late alert gets 0. With ``expire`` (an interval such as
    ``30 days``) a key that is silent for longer than that before the newest alert is
    forgotten, so the state holds active keys only and its next alert counts as a first
    one. A keyed state operator would bring all alerts of a host to one task; here a host
    with a third of the feed is spread as in a batch.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = state.before(spark, batch_id)
        batch = batch.persist()         # read several times below
        sink(features.recency(batch, keys, last_seen=known), batch_id)
        now = features.last_seen(batch.filter(F.col("timestamp").isNotNull()), keys)
        merged = (now if known is None else now.unionByName(known)).groupBy(*keys).agg(F.max("last_ts").alias("last_ts"))
        if expire:
            newest = F.broadcast(merged.agg((F.max("last_ts") - F.expr(f"INTERVAL {expire}")).alias("_oldest")))     # one row
            merged = merged.join(newest).filter("last_ts >= _oldest").drop("_oldest")
        state.write(merged, batch_id)
        batch.unpersist()

    return step


def feature_step(stats: dict[str, DataFrame], score: Callable[[DataFrame], DataFrame],
                 state: VersionedState, sink: Callable[[DataFrame, int], None],
                 hash_kind: str = "blake2b") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: frozen features with carried recency, then a frozen scorer, then the sink."""
    median = stats["globals"].first()["recency_median"]

    def with_features(batch: DataFrame, batch_id: int) -> None:
        base = batch.withColumns(times.calendar_features(F.col("timestamp")))
        base = features.add_host_z(base, stats["host_stats"])
        sink(score(features.finish(base, median, stats["combo_freq"], hash_kind)), batch_id)

    return recency_step(state, with_features)


def enrichment_sink(path: str, columns: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Score, rank input and reasons per event: one folder per batch, days inside."""
    def write(df: DataFrame, batch_id: int) -> None:
        out = df.withColumn("day", F.to_date("timestamp"))
        out = out.select(*[c for c in columns if c in out.columns], "day") if columns else out
        out.write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def daily_queue_step(path: str, score: Callable[[DataFrame], DataFrame],
                     k: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: merge the batch into the Top-K queues of the days it touches.

    Each batch writes these days anew below its own folder; other days are neither
    read nor written.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = score(batch).drop("rank", "day").persist()
        if not fresh.limit(1).count():
            return
        days = fresh.select(F.to_date("timestamp").alias("_day")).distinct()
        known = daily_queue(spark, path, batch_id)
        pool = fresh if known is None else fresh.unionByName(
            known.join(small_side(days), F.col("day").eqNullSafe(F.col("_day")), "left_semi").drop("rank", "day"))
        rank.top_k_per_day(pool, k).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")
        fresh.unpersist()

    return step


def daily_queue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Each day's queue as its last batch (earlier than ``before``) left it; None if there is none yet."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    # the newest batch of each day is known from the folder names
    last = rows.groupBy(F.col("day").alias("_day")).agg(F.max("batch").alias("_batch"))
    newest = F.col("day").eqNullSafe(F.col("_day")) & (F.col("batch") == F.col("_batch"))     # a missing day is one too
    return rows.join(small_side(last), newest, "left_semi").drop("batch")


def run_available(df: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None],
                  mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    q = (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(body).start()
    )
    q.awaitTermination()
    return q


def run_to_parquet(df: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Append a streaming frame to Parquet until the feed is drained; the rows written."""
    q = (
        df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).format("parquet").start(path)
    )
    q.awaitTermination()
    return df.sparkSession.read.parquet(path)


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Final rows of an update-mode stream written as ``batch=<id>`` folders."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    last = F.max_by(F.struct(*rest), F.col("batch")).alias("_r")
    return rows.groupBy(*keys).agg(last).select(*keys, "_r.*")


def batch_folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write
