"""Structured Streaming forms of snapshots, status changes, submissions, cache counters and experiments.

Every result goes to files below the shared folder, one sub-folder per micro-batch that is overwritten
when a batch is replayed after a failure. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkreel import lexicon as lx
from sparkreel.operators import ordered, statistics
from sparkreel.operators.state import hold_submissions
from sparkreel.session import new_folder
from sparkreel.streaming.keyed_state import KeyedState


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def read_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int | None = None) -> DataFrame:
    """A file stream of one table, a folder of part files or a single file, with at most ``files`` files per micro-batch.

    ``ts`` becomes an instant, read as UTC, since watermarks need one.
    """
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")))
    return rows.withColumn("ts", instant)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], work: str, mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{work}/checkpoint")
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()


def _write(df: DataFrame, work: str, part: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{work}/{part}/batch={batch}")


def newest_per_key(spark: SparkSession, work: str, keys: list[str]) -> DataFrame:
    """Current rows of an update-mode result: per key the row of its latest batch."""
    rows = spark.read.parquet(f"{work}/updates")
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _batches(work: str, spark: SparkSession) -> int:
    """How many batches were finished, from the query's own log of commits."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/checkpoint/commits")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    return 1 + max((int(n) for n in names if n.isdigit()), default=-1)


def snapshot_stream(events: DataFrame, work: str) -> DataFrame:
    """Append every snapshot and keep the newest row per clip.

    ``events`` has clip_id, ts, seq and metric columns. A batch writes its snapshots and the newest rows of its own clips; the state of
    the other clips is left where it is (``keyed_state``).
    """
    spark = events.sparkSession
    current = KeyedState(spark, f"{work}/current", ["clip_id"], _ddl(events))
    rest = [c for c in events.columns if c != "clip_id"]

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _write(batch, work, "snapshots", number)
        known = current.before(number).join(batch.select("clip_id").distinct(), "clip_id", "left_semi")
        current.put(number, known.unionByName(batch).groupBy("clip_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select("clip_id", "r.*"))
        batch.unpersist()

    run_batches(events, handle, work)
    return current.before(_batches(work, spark))


def windowed_counts(events: DataFrame, work: str, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Snapshots and watch time per event-time window; rows later than ``delay`` are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total")
    run_batches(counted, lambda df, number: _write(df, work, "updates", number), work, "update")
    return newest_per_key(events.sparkSession, work, ["window_start", "event_type"])


def status_change_stream(events: DataFrame, work: str, ttl: int | None = None) -> DataFrame:
    """Changes of job status or progress across micro-batches, ended by the first terminal status.

    The state is the last row of every job and whether its life has ended. A batch reads the state of its own jobs and writes those only
    (``keyed_state``). With ``ttl``, jobs silent for longer leave the state, as ``ordered.status_changes`` starts a new life after
    such a gap in any case: the changes are those of one batch over all rows, as long as a job's rows come in the order of time.
    """
    spark = events.sparkSession
    state = KeyedState(spark, f"{work}/state", ["job_id"], f"{_ddl(events)}, ended boolean")
    kept = [c for c in events.columns if c != "job_id"]

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        now = batch.agg(F.max("ts")).first()[0]
        alive = None if ttl is None or now is None else F.col("ts") >= F.lit(now) - F.make_interval(secs=F.lit(ttl))
        # Rows of a batch may be older than its newest one, so a job's silence is judged row by row, not here.
        known = state.before(number).join(batch.select("job_id").distinct(), "job_id", "left_semi")
        rows = batch.withColumn("ended", F.lit(None).cast("boolean")).unionByName(known)
        _write(ordered.status_changes(rows, ttl=ttl, carried="ended").drop("ended"), work, "changes", number)
        state.put(number, _last_rows(rows, kept, ttl), alive)
        batch.unpersist()

    run_batches(events, handle, work)
    return spark.read.parquet(f"{work}/changes").drop("batch")


def _last_rows(rows: DataFrame, kept: list[str], ttl: int | None) -> DataFrame:
    """The last row of every job, and whether the life it belongs to has ended: a terminal status, or a carried end, since the last gap."""
    order = F.struct("ts", "event_id")
    over = F.coalesce("ended", F.col("status").isin(*ordered.ENDED))
    if ttl is None:
        return rows.groupBy("job_id").agg(F.max_by(F.struct(*kept), order).alias("r"), F.bool_or(over).alias("ended")).select("job_id", "r.*", "ended")
    gaps = ordered.with_neighbours(rows, ["job_id"], F.date_trunc("minute", "ts"), ["ts", "event_id"], ["ts"], following=None)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = F.when(micros("ts") - micros("prev.ts") > ttl * 1_000_000, order)
    facts = gaps.groupBy("job_id").agg(F.max_by(F.struct(*kept), order).alias("r"), F.max(fresh).alias("life"), F.max(F.when(over, order)).alias("end"))
    # The life has ended if its last terminal row is not before its first one.
    return facts.select("job_id", "r.*", (F.col("end").isNotNull() & (F.col("life").isNull() | (F.col("end") >= F.col("life")))).alias("ended"))


def dedup_stream(submissions: DataFrame, work: str, delay: str = "3 hours") -> DataFrame:
    """Submissions of which no other with the same video arrived within the job's time to live."""
    unique = submissions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id"])
    run_batches(unique, lambda df, number: _write(df, work, "unique", number), work)
    return submissions.sparkSession.read.parquet(f"{work}/unique").drop("batch")


def submission_stream(events: DataFrame, work: str, finished_ttl: int = 3600, running_ttl: int = 10800) -> DataFrame:
    """Submissions that start a job: one active job per video, freed by failure or by its time to live (``state.hold_submissions``).

    ``events(video_id, job_id, ts, seq, status)``. The state is who holds each video, since when and how far it is; a batch reads and
    writes the videos it names only. Holders past their time leave the state.
    """
    spark = events.sparkSession
    state = KeyedState(spark, f"{work}/holders", ["video_id"], "video_id string, holder string, created timestamp, state string")

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        now = batch.agg(F.max("ts")).first()[0]
        alive = None if now is None else F.col("created") >= F.lit(now) - F.make_interval(secs=F.lit(max(finished_ttl, running_ttl)))
        # Rows of a batch may be older than its newest one, so what is past its time is judged row by row, not here.
        started, held = hold_submissions(batch, state.before(number), finished_ttl, running_ttl)
        _write(started, work, "started", number)
        state.put(number, held, alive)
        batch.unpersist()

    run_batches(events, handle, work)
    return spark.read.parquet(f"{work}/started").drop("batch")


def cache_metric_stream(events: DataFrame, work: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Cache hits and misses per window (ts, hit)."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w")).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).select(
        F.unix_seconds("w.start").alias("window_start"), "hits", "misses")
    run_batches(counted, lambda df, number: _write(df, work, "updates", number), work, "update")
    return newest_per_key(events.sparkSession, work, ["window_start"])


def live_ab(observations: DataFrame, work: str) -> DataFrame:
    """Experiment result kept up to date from a stream of (experiment_id, arm, value).

    The stream holds counts, means and variances per arm only; the test runs on those few rows.
    """
    spark = observations.sparkSession
    per_arm = observations.groupBy(F.coalesce("experiment_id", F.lit(lx.ACTIVE_EXPERIMENT)).alias("experiment_id"), "arm").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    run_batches(per_arm, lambda df, number: _write(df, work, "updates", number), work, "update")
    arms = newest_per_key(spark, work, ["experiment_id", "arm"])
    of = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{c}_{arm}")
    wide = arms.groupBy("experiment_id").agg(*[of(c, arm) for arm in ("A", "B") for c in ("n", "mean", "var")])
    return statistics.judge_arms(wide.fillna(0, ["n_A", "n_B"]))


def work_folder(spark: SparkSession, name: str) -> str:
    return new_folder(spark, f"stream-{name}")
