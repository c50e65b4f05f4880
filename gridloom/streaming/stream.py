"""Structured Streaming forms: windowed counts, labels behind a watermark, keyed latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, time: str, by: list[str], value: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """by, start, n, mean per tumbling window; rows later than the watermark are left out."""
    marked = events.withWatermark(time, late)
    out = marked.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(*by, F.col("window.start").alias("start"), "n", "mean")


def session_stops(events: DataFrame, time: str, by: list[str], gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """by, start, end, n of sessions: runs of events at most gap apart."""
    marked = events.withWatermark(time, late)
    out = marked.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(docs: DataFrame, key: Column, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key inside the watermark; state of older keys is dropped."""
    return docs.withColumn("_key", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drains a stream into a memory table and returns it; for tests and small reports."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def known_labels(steps: DataFrame, starts: DataFrame, horizon: str, late: str = "1 hour") -> DataFrame:
    """turbine, step, label as a stream: whether an event starts within the horizon after each step, told once the watermark has passed it.

    steps(turbine, step) and starts(turbine, start) are streams of timestamps. A
    step without an event is known to have none only then.
    """
    a = steps.withWatermark("step", late).select(F.col("turbine").alias("_t"), "step")
    b = starts.withWatermark("start", late)
    span = (F.col("_t") == F.col("turbine")) & (F.col("start") > F.col("step")) & (F.col("start") <= F.col("step") + F.expr(f"INTERVAL {horizon}"))
    met = a.join(b, span, "left_outer")
    return met.select(F.col("_t").alias("turbine"), "step", F.col("start").isNotNull().alias("label"))


def hours_since_last(rows: DataFrame, keys: list[str], time: str, event: str, cap: float) -> DataFrame:
    """Rows(keys, time, event flag) as a stream with hours since the key's last event, at most cap, null before the first; one timestamp of state a key.

    Rows of a batch are taken in the order of time; later batches go on from the state.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField(time, kinds[time]), T.StructField("hours", T.DoubleType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.NaT
        data = pd.concat(list(batches)).sort_values(time, kind="stable")
        seen = data[time].where(data[event].astype(bool)).ffill().fillna(last)
        hours = ((data[time] - seen).dt.total_seconds() / 3600).clip(upper=cap)
        if pd.notna(seen.iloc[-1]):
            state.update((int(seen.iloc[-1].value // 1000),))
        yield pd.DataFrame({**{k: [v] * len(data) for k, v in zip(keys, key, strict=True)}, time: data[time], "hours": hours})

    grouped = rows.groupBy(*keys)
    return grouped.applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def latest_revision(docs: DataFrame, key: str, version: str) -> DataFrame:
    """The greatest version of each key as a stream in update mode: a row each time that a later one comes in."""
    rest = [c for c in docs.columns if c != key]
    return docs.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")
