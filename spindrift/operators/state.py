"""Quotas, caches, retention, job queues and their liveness, over event tables. Every clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as V
from ..functions.scalars import half_up, local_date
from .relational import first_of_each, running, upper_medians
from .sequences import overlapping


def admitted(log: DataFrame, by: list[str], ts: str, key: str, limit: Column) -> DataFrame:
    """Marks requests admitted: the first so many of each group (a user's day) in order of time."""
    w = Window.partitionBy(*by).orderBy(ts, key)
    return log.withColumn("nth", F.row_number().over(w)).withColumn("admitted", F.col("nth") <= limit)


def usage_today(log: DataFrame, feature: str, ts: str, as_of: Column, hours: int = 9) -> DataFrame:
    return log.where(local_date(F.col(ts), hours) == local_date(as_of, hours)).groupBy(feature).agg(F.count(F.lit(1)).alias("used"))


def fresh(cache: DataFrame, created: str, as_of: Column, ttl: str) -> DataFrame:
    return cache.where(F.col(created) > as_of - F.expr(f"INTERVAL {ttl}"))


def retention(df: DataFrame, date: str, as_of: Column, days: int = 90) -> DataFrame:
    return df.withColumn("kept", F.col(date) >= F.date_sub(F.to_date(as_of), days))


def outcomes(calls: DataFrame, blocked: str, ok: str, code: str, free: str = "QUOTA_USER_DAILY_FREE") -> DataFrame:
    """One row: calls by outcome (blocked before ok) and the failure rate in per cent."""
    kind = F.when(F.col(blocked), "blocked").when(F.col(ok), "ok").when(F.col(code) == free, "quota_free").otherwise("error")
    one = calls.select(kind.alias("o")).agg(*[F.count_if(F.col("o") == k).alias(k) for k in ("blocked", "ok", "quota_free", "error")], F.count(F.lit(1)).alias("total"))
    return one.withColumn("fail_rate", F.when(F.col("total") > 0, half_up(F.col("error") * 100 / F.col("total"))).otherwise(0).cast("long"))


def oldest_queued(jobs: DataFrame, by: list[str], created: str, key: str) -> DataFrame:
    """The job each queue gives out next."""
    return jobs.where("status = 'queued'").groupBy(*by).agg(F.min_by(key, F.struct(created, key)).alias(key), F.min(created).alias(created))


def enqueued_once(jobs: DataFrame, key: str, created: str, job: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(created, job)
    return jobs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stalled(beats: DataFrame, by: list[str], at: str, submitted: str, as_of: Column, gap: int = 60, first: int = 120, early: int = 30) -> DataFrame:
    """Workers with no beat for more than gap seconds, or first seconds after submission before any beat. Beats from more
    than early seconds before the submission don't count."""
    valid = F.when(F.col(at) >= F.col(submitted) - F.expr(f"INTERVAL {early} SECONDS"), F.col(at))
    one = beats.groupBy(*by).agg(F.max(valid).alias("last_beat"), F.max(submitted).alias(submitted))
    idle = lambda c: (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / 1e6
    return one.withColumn("stalled", F.when(F.col("last_beat").isNull(), idle(submitted) > first).otherwise(idle("last_beat") > gap))


def beat_gaps(beats: DataFrame, by: list[str], at: str, key: str, gap: int = 60) -> DataFrame:
    """Gaps between a worker's beats of more than gap seconds."""
    w = Window.partitionBy(*by).orderBy(at, key)
    seconds = (F.unix_micros(F.lead(at).over(w).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return beats.withColumn("gap", seconds).where(F.col("gap") > gap)


def requeued(jobs: DataFrame, beats: DataFrame, job: str, started: str, as_of: Column, minutes: int = 10) -> DataFrame:
    """Running jobs whose last sign of life (the last beat or the start) is more than minutes old go back to the queue, with
    attempts reset."""
    last = F.greatest(F.coalesce("last_beat", started), F.col(started))
    idle = (F.col("status") == "running") & (last < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    both = jobs.join(beats.groupBy(job).agg(F.max("at").alias("last_beat")), job, "left")
    return both.withColumn("orphan", F.coalesce(idle, F.lit(False))).withColumn("status", F.when(F.col("orphan"), "queued").otherwise(F.col("status"))).withColumn("attempts", F.when(F.col("orphan"), 0).otherwise(F.col("attempts"))).drop("last_beat")


def failed_stuck(jobs: DataFrame, started: str, as_of: Column, minutes: int = 90) -> DataFrame:
    stuck = (F.col("status") == "running") & (F.col(started) < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("status", F.when(F.coalesce(stuck, F.lit(False)), "failed").otherwise(F.col("status")))


def guarded(df: DataFrame, column: str, value: Column, status: str, allowed: list[str]) -> DataFrame:
    """A column that changes only while the status is one of those allowed."""
    return df.withColumn(column, F.when(F.col(status).isin(allowed), value).otherwise(F.col(column)))


def last_samples(samples: DataFrame, stage: str, order: str, n: int = 12) -> DataFrame:
    w = Window.partitionBy(stage).orderBy(F.col(order).desc())
    return samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def deadlines(samples: DataFrame, stage: str, per_frame: str, frames: Column, factor: float = 2.5, floor_ms: int = 180_000) -> DataFrame:
    """By stage: the upper median of seconds per frame, and the deadline in ms."""
    out = upper_medians(samples, [stage], per_frame)
    return out.withColumn("deadline_ms", F.greatest(F.lit(floor_ms), half_up(F.col("median") * frames * factor * 1000)).cast("long"))


def outliers(samples: DataFrame, stage: str, value: str, factor: float = 3.0, least: int = 4) -> DataFrame:
    stats = upper_medians(samples, [stage], value)
    return samples.join(stats, stage).where((F.col("n") >= least) & (F.col(value) > factor * F.col("median")))


def rate_limited(log: DataFrame, by: list[str], ts: str, window: str, limit: int) -> DataFrame:
    """Windows in which a key makes more calls than the limit."""
    out = log.groupBy(*by, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("calls")).where(F.col("calls") > limit)
    return out.select(*by, F.col("w.start").alias("window_start"), "calls")


def sessions(log: DataFrame, by: list[str], ts: str, key: str, gap_seconds: int) -> DataFrame:
    """Runs of events with pauses of at most gap_seconds."""
    from .sequences import islands

    w = Window.partitionBy(*by).orderBy(ts, key)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    out = islands(log, by, [ts, key], seconds > gap_seconds, "session")
    return out.groupBy(*by, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"))


def until_first_hit(df: DataFrame, by: list[str], position: str, hit: Column) -> DataFrame:
    """Rows up to a group's first hit, or all of them without one."""
    first = F.min(F.when(hit, F.col(position))).over(Window.partitionBy(*by))
    return df.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(position) <= F.col("_first"))).drop("_first")


def ready(segments: DataFrame, chunks: DataFrame, by: list[str], segment: str) -> DataFrame:
    """Segments (f0, f1 exclusive) all of whose overlapping chunks (s, e inclusive) are done.

    No pairs are made: of the chunks that begin before a segment's end, all but
    those that end before its start overlap it, so running counts at both ends
    tell how many there are, and how many are done or not. This holds for ranges
    that aren't empty or turned round; of others the pairs are counted.
    """
    known = lambda df, *c: df.where(" AND ".join(f"`{x}` IS NOT NULL" for x in (*by, *c)))
    segments = known(segments, "f0", "f1").select(*by, segment, "f0", "f1")
    done = F.col("status") == "done"
    chunks = known(chunks, "s", "e").select(*by, "s", (F.col("e") + 1).alias("_after"), F.lit(1).alias("_all"), F.coalesce(done, F.lit(False)).cast("int").alias("_done"), F.coalesce(~done, F.lit(False)).cast("int").alias("_open"))
    counts = ["_all", "_done", "_open"]
    odd_segment, odd_chunk = F.col("f0") >= F.col("f1"), F.col("s") > F.col("_after")

    none = F.lit(0).cast("long")
    total = lambda df, at, kind: df.groupBy(*by, F.col(at).alias("_at")).agg(*[F.sum(c).alias(f"{kind}{c}") for c in counts]).select("*", *[none.alias(f"{k}{c}") for k in "be" if k != kind for c in counts])
    plain = chunks.where(~odd_chunk)
    nobody = segments.select(segment).schema[0].dataType
    side = lambda df, rank: df.withColumns({"_rank": F.lit(rank), segment: F.lit(None).cast(nobody)})
    asked = segments.where(~odd_segment).select(*by, segment, F.explode(F.array(F.struct(F.col("f0").alias("_at"), F.lit(0).alias("_end")), F.struct(F.col("f1").alias("_at"), F.lit(1).alias("_end")))).alias("x")).select(*by, segment, "x.*")
    asked = asked.select("*", F.lit(1).alias("_rank"), *[none.alias(f"{k}{c}") for k in "be" for c in counts])
    # at one place ends come first, then the questions, then starts: e + 1 <= f0 ends before, s = f1 begins after
    rows = asked.unionByName(side(total(plain, "s", "b"), 2), allowMissingColumns=True).unionByName(side(total(plain, "_after", "e"), 0), allowMissingColumns=True)
    so_far = running(rows, by, [F.col("_at"), F.col("_rank"), F.col(segment), F.col("_end")], {f"{k}{c}": f"_so_far_{k}{c}" for k in "be" for c in counts})
    met = so_far.where("_rank = 1").groupBy(*by, segment).agg(*[F.sum(F.when(F.col("_end") == 1, F.col(f"_so_far_b{c}")).otherwise(-F.col(f"_so_far_e{c}"))).alias(c) for c in counts])
    pairs = []
    if segments.where(odd_segment).limit(1).count():
        pairs.append(overlapping(segments.where(odd_segment), chunks, by, ("f0", "f1"), ("s", "_after")))
    if chunks.where(odd_chunk).limit(1).count():
        pairs.append(overlapping(segments.where(~odd_segment), chunks.where(odd_chunk), by, ("f0", "f1"), ("s", "_after")))
    for both in pairs:
        met = met.unionByName(both.groupBy(*by, segment).agg(*[F.sum(c).alias(c) for c in counts]))
    if pairs:
        met = met.groupBy(*by, segment).agg(*[F.sum(c).alias(c) for c in counts])
    return met.where("_all > 0").select(*by, segment, F.when(F.col("_open") > 0, False).when(F.col("_done") > 0, True).alias("ready"))


def workers(jobs: DataFrame, normal: int = 5, congested: int = 3, busy: int = 3) -> DataFrame:
    active = F.count_if(F.col("status").isin("queued", "running"))
    return jobs.agg(active.alias("active")).withColumn("workers", F.when(F.col("active") >= busy, congested).otherwise(normal))


def stopwatch(samples: DataFrame, stage: str, seconds: Column) -> DataFrame:
    """Seconds by stage to one digit, and runs."""
    return samples.groupBy(stage).agg((half_up(F.sum(seconds).cast("double") * 10) / 10).alias("seconds"), F.count(F.lit(1)).alias("runs"))


def next_job(done: Column, objective: Column, has_audio: Column, sentences: Column, least: int = 10) -> Column:
    """The job that follows one that is done: after a probe by the project's objective, or a transcript where there is sound;
    after a transcript of enough sentences an analysis; else none."""
    after_probe = F.when(objective == "desilence", "desilence").when(objective == "wm_remove", "wmremove").when(has_audio, "transcribe")
    return F.when(done == "probe", after_probe).when((done == "transcribe") & (sentences >= least), "analyze")


def claimed(chunks: DataFrame, workers: DataFrame, by: list[str], chunk: str, worker: str) -> DataFrame:
    """Each project's waiting chunks, the lowest first, to its idle workers: each chunk to one worker, each worker one chunk."""
    place = lambda df, c: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(c)))
    waiting = place(chunks.where("status = 'todo'").select(*by, chunk), chunk)
    return place(workers, worker).join(waiting, [*by, "_n"]).select(*by, worker, chunk)


def stage_json(samples: DataFrame, stage: str, order: str, seconds: str, n: int = 12) -> DataFrame:
    """One JSON value with each stage's last n samples, the newest first, as it is kept among the settings."""
    last = first_of_each(samples.withColumn("_order", -F.col(order)), [stage], "_order", seconds, n)
    return last.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(stage, "texts")))).alias("value"))  # a row a stage


def stage_samples(settings: DataFrame, value: str = "value") -> DataFrame:
    """stage, at, seconds from that value; one that isn't valid has none."""
    return settings.select(F.explode(F.from_json(value, "map<string, array<double>>")).alias("stage", "s")).select("stage", F.posexplode("s").alias("at", "seconds"))


def after_error(jobs: DataFrame) -> DataFrame:
    """Jobs (status, job_type, attempts, final) after a pass: one in error goes back to the queue if it was not tried before and
    may be, else it has failed, and with it its project (project_status)."""
    error = F.col("status") == "error"
    again = error & (F.coalesce("attempts", F.lit(0)) < 1) & ~F.coalesce("final", F.lit(False))
    names = F.create_map(*[F.lit(x) for pair in V.FAILED_STATUS.items() for x in pair])
    failed = F.coalesce(F.element_at(names, F.col("job_type")), F.lit(V.FAILED_OTHER))
    return jobs.withColumns({"project_status": F.when(error & ~again, failed), "status": F.when(again, "queued").when(error, "failed").otherwise(F.col("status"))})


def claimable(jobs: DataFrame, project: str, job: str) -> DataFrame:
    """project, job: the oldest queued job of each project without a running one."""
    running = jobs.where("status = 'running'").select(project).distinct()
    return jobs.where("status = 'queued'").join(running, project, "left_anti").groupBy(project).agg(F.min(job).alias(job))
