"""Event-time windows, keyed alarms and incremental tables on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.regime import BETS, alarm_step, mixture_wealth


def windowed_counts(events: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per event-time window; rows later than `late` behind the newest are dropped by the watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def evidence_once(evidence: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Each evidence id once within the watermark: a second delivery is refused."""
    return evidence.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def keyed_alarm(events: DataFrame, key: str, time: str, predicted: str, realized: str, scale: str, alpha: float = 0.05) -> DataFrame:
    """(key, n, wealth, alarm, hit) after each micro-batch of a key's rows: the mixture martingale of operators.regime carried in state. Rows of a key in a batch are taken by time; values that are not finite abstain."""
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, hit, wealth = (state.get[0], state.get[1], list(state.get[2:])) if state.exists else (0, False, [0.0] * len(BETS))
        for e in pd.concat(list(batches)).sort_values(time).itertuples():
            p, r, s = getattr(e, predicted), getattr(e, realized), getattr(e, scale)
            if pd.notna(p) and pd.notna(r) and pd.notna(s) and s > 0:
                wealth = alarm_step(wealth, p, r, s)
                n += 1
                hit = hit or mixture_wealth(wealth) >= 1 / alpha
        state.update((n, hit, *wealth))
        now = mixture_wealth(wealth)
        yield pd.DataFrame([(k[0], n, now, now >= 1 / alpha, hit)], columns=[key, "n", "wealth", "alarm", "hit"])

    states = "n long, hit boolean, " + ", ".join(f"w{i} double" for i in range(len(BETS)))
    return events.select(key, time, predicted, realized, scale).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, wealth double, alarm boolean, hit boolean", states, "update", GroupStateTimeout.NoTimeout)


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A started query that appends each micro-batch's unseen keys to a parquet table: a batch that is delivered again finds its own keys and adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            held = spark.read.parquet(path).select(key)
            new = new.join(held, key, "left_anti")
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str = "append"):
    """Runs what is available to an in-memory table of that name, for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
