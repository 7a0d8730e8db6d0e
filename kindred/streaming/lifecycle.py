"""The featurization lifecycle of jobs: states, readiness, recovery; as tables and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("_r", rank).where("_r = 1").drop("_r")


def not_ready(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs without a state or with another than ready."""
    return jobs.join(states.where("state = 'ready'").select("job_id"), "job_id", "left_anti")


def reset_stale(states: DataFrame, cutoff: Column) -> DataFrame:
    """Featurizing jobs that began before the cutoff start again at progress 0."""
    stale = (F.col("state") == "featurizing") & (F.col("started_at") < cutoff)
    return states.withColumn("progress", F.when(stale, 0.0).otherwise(F.col("progress"))).withColumn("reset", F.coalesce(stale, F.lit(False)))


def recover(jobs: DataFrame, cached: DataFrame, states: DataFrame, cutoff: Column, now: Column) -> DataFrame:
    """The states after a start: (job_id, state, progress, started_at, reset, enqueued) of all known jobs.

    Found ``jobs`` (job_id, completed_at) join the ``cached`` ones; the state of
    a new or changed job goes, as all that hung on its old version. Jobs that
    were featurizing since before the cutoff are reset. All jobs that are not
    ready then start again from 0 at ``now``. Run again at once it changes
    nothing but that time.
    """
    from kindred.operators.store import stale_jobs

    changed = stale_jobs(cached, jobs).where("state <> 'fresh'").select("job_id")
    known = cached.select("job_id").union(jobs.select("job_id")).distinct()
    kept = states.select("job_id", "state", "progress", "started_at").join(changed, "job_id", "left_anti")
    was = reset_stale(kept, cutoff)
    both = known.join(was, "job_id", "left").withColumn("reset", F.coalesce("reset", F.lit(False)))
    again = F.coalesce(F.col("state") != "ready", F.lit(True))
    return both.select(
        "job_id", F.when(again, "featurizing").otherwise(F.col("state")).alias("state"), F.when(again, 0.0).otherwise(F.col("progress")).alias("progress"),
        F.when(again, now).otherwise(F.col("started_at")).alias("started_at"), "reset", again.alias("enqueued"),
    )


def fleet_counts(states: DataFrame) -> DataFrame:
    is_ = lambda c: F.count_if(c).cast("long")
    busy = F.col("state") == "featurizing"
    return states.agg(
        is_(F.col("state") == "ready").alias("ready"), is_(busy & (F.coalesce("progress", F.lit(0.0)) <= 0)).alias("queued"),
        is_(busy & (F.col("progress") > 0)).alias("in_progress"), is_(F.col("state") == "failed").alias("failed"),
    )


def job_status(requests: DataFrame, states: DataFrame) -> DataFrame:
    """``requests`` (job_id, ...) with found and the state of each job asked for; null where nothing is known of it."""
    return requests.join(states.withColumn("found", F.lit(True)), "job_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def retry_after(states: DataFrame, group: str) -> DataFrame:
    """Seconds to wait for each group that is not ready: from its least positive progress p, 10 (1 - p) / p within 2..60; 10 without progress."""
    waiting = states.where("state <> 'ready'").groupBy(group).agg(F.min(F.when(F.col("progress") > 0, F.col("progress"))).alias("p"))
    wait = F.greatest(F.lit(2.0), F.least(F.lit(60.0), F.round(10.0 * (1.0 - F.col("p")) / F.col("p"))))
    return waiting.select(group, F.coalesce(wait, F.lit(10.0)).cast("long").alias("retry_after"))


def readiness_gate(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """(request_id, accepted, retry_after) of ``candidates`` (request_id, job_id): a request with any job that is not ready is turned away, with the seconds to wait."""
    both = candidates.join(states.select("job_id", "state", "progress"), "job_id", "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    waits = retry_after(both, "request_id")
    return candidates.select("request_id").distinct().join(waits, "request_id", "left").select("request_id", F.col("retry_after").isNull().alias("accepted"), "retry_after")


#: Shares of a job's work that are done when a step ends: fixed values.
STEPS = {"images": 0.80, "baselines": 0.82, "uniqueness": 0.85, "aggregates": 0.92, "statistics": 0.97}


def progress(step: Column, done: Column, total: Column) -> Column:
    """Progress of a job: its share of images up to the first fixed step, then the steps."""
    out = F.lit(None).cast("double")
    for name, share in STEPS.items():
        out = F.when(step == name, F.lit(share) * F.coalesce(F.try_divide(done, total), F.lit(0.0)) if name == "images" else F.lit(share)).otherwise(out)
    return out


def discover(jobs: DataFrame, cached: DataFrame, states: DataFrame) -> DataFrame:
    """(job_id, reason) of the jobs to featurize: new or changed since they were ``cached``, and not in flight; changed ones even if they were ready."""
    from kindred.operators.store import stale_jobs

    wanted = stale_jobs(cached, jobs).where("state <> 'fresh'").select("job_id", F.col("state").alias("reason"))
    return wanted.join(states.where("state = 'featurizing'").select("job_id"), "job_id", "left_anti")


def to_enqueue(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Distinct requested jobs that are neither ready nor in flight."""
    return requests.dropDuplicates(["job_id"]).join(states.where("state IN ('ready', 'featurizing')").select("job_id"), "job_id", "left_anti")


def refeaturize_on_change(jobs: DataFrame, featurize: Callable[[DataFrame, int], None], checkpoint: str):
    """A query over a stream of job rows: each batch's newest row of a job goes to ``featurize``, which must be idempotent."""

    def batch(df: DataFrame, epoch: int) -> None:
        featurize(latest_state(df, "job_id", ["completed_at"]), epoch)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_state(now: tuple[str, float], kind: str, progress: float) -> tuple[str, float]:
    """State and progress after an event; events that don't fit the state are passed over."""
    if kind == "enqueue" and now[0] in ("absent", "failed"):
        return "featurizing", 0.0
    if now[0] == "featurizing":
        if kind == "progress":
            return "featurizing", max(now[1], float(progress))
        if kind == "done":
            return "ready", 1.0
        if kind == "failed":
            return "failed", now[1]
    return now


def track_states(events: DataFrame) -> DataFrame:
    """Streaming states of jobs: (job_id, state, progress) after each batch that touches a job, from (job_id, kind, progress) events."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    from kindred.sources.package import ship

    ship(events.sparkSession)

    def step(key, batches, state: GroupState):
        now = state.get if state.exists else ("absent", 0.0)
        for rows in batches:
            for kind, progress in zip(rows["kind"], rows["progress"], strict=True):
                now = next_state(now, kind, progress)
        state.update(now)
        yield pd.DataFrame({"job_id": [key[0]], "state": [now[0]], "progress": [now[1]]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, state string, progress double", "state string, progress double", "update", "NoTimeout")


def watch_progress(events: DataFrame, patience_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """Streaming states of jobs that reset themselves: (job_id, state, progress, reset, at) whenever a job's state changes.

    events: (job_id, kind, progress, at). The kinds are those of
    track_states(). A featurizing job that sends no event for
    ``patience_seconds`` of event time goes back to progress 0 and waits as
    long again; each job has one timer. Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    from kindred.sources.package import ship

    ship(events.sparkSession)
    patience = patience_seconds * 1000

    class Watch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.now = handle.getValueState("now", "state string, progress double")

        def _wait(self, since: int | None) -> None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if since is not None:
                self.handle.registerTimer(since + patience)

        def _out(self, key, reset: bool, at: int):
            state, progress = self.now.get()
            return pd.DataFrame({"job_id": [key[0]], "state": [state], "progress": [progress], "reset": [reset], "at": [pd.Timestamp(at, unit="ms")]})

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            rows = pd.concat(list(rows)).sort_values("at", kind="stable")
            now = self.now.get() if self.now.exists() else ("absent", 0.0)
            now = (now[0], now[1])
            for kind, progress in zip(rows["kind"], rows["progress"], strict=True):
                now = next_state(now, kind, progress)
            self.now.update(now)
            at = int(rows["at"].iloc[-1].value // 1_000_000)
            self._wait(at if now[0] == "featurizing" else None)
            yield self._out(key, False, at)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            at = expiredTimerInfo.getExpiryTimeInMs()
            if self.now.exists() and self.now.get()[0] == "featurizing":
                self.now.update(("featurizing", 0.0))
                self._wait(at)
                yield self._out(key, True, at)

    timed = events.withWatermark("at", delay).groupBy("job_id")
    return timed.transformWithStateInPandas(Watch(), "job_id string, state string, progress double, reset boolean, at timestamp", "Update", "EventTime")


def eviction_loop(reads: DataFrame, store: str, budget: int, checkpoint: str, trigger: dict, report=None):
    """A query over a stream of feature reads (source, ref_id, at) that keeps the store within its budget.

    The store is a folder of versions, v=0 the first. Each batch moves access
    times on, evicts, and writes the next version under the batch's own number,
    so that a batch that is run again after a crash changes nothing. ``report``
    is called with (version, rows, bytes freed).
    """
    from kindred.operators.store import evict_features, touch

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        target = f"{store}/v={epoch + 1}"
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return
        kept, n, freed = evict_features(touch(spark.read.parquet(f"{store}/v={epoch}"), df), budget)
        kept.write.mode("overwrite").parquet(target)
        if report:
            report(epoch + 1, n, freed)

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
