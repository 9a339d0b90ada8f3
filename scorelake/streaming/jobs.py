"""Streaming forms: scoring, dashboards, alerts, heartbeats and file pickup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.registry import Model
from ..operators.scoring import Scorer, score
from ..operators.telemetry import alerts, dashboard
from ..schemas import RUN


def score_stream(src: DataFrame, model: Model, **kwargs) -> DataFrame:
    """Score each arriving micro-batch; stateless, so the plan equals the batch one."""
    return score(src, model, **kwargs)


def score_batches(src: DataFrame, models: list[Model], out: str, checkpoint: str, metrics: bool = True, **kwargs) -> DataStreamWriter:
    """Score through ``foreachBatch``. Each batch overwrites its own folder, so a
    batch that is replayed after a failure leaves no duplicates. With ``metrics``
    the folder also holds the batch's task rows; ``split_scored`` parts them."""

    # Weights are broadcast once for the whole query, not once for each batch.
    scorer = Scorer(src.sparkSession, models, **{k: v for k, v in kwargs.items() if k in ("batch_size", "device_mode", "dtype")})
    columns = {k: v for k, v in kwargs.items() if k in ("input_col", "id_cols")}

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = scorer(batch, metrics=metrics, **columns)
        scored.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dashboard_stream(src: DataFrame, period: str, by: list[str], lateness: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Closed dashboard windows; readings later than ``lateness`` are not waited for."""
    return dashboard(src.withWatermark(ts, lateness), period, by, ts, value)


def alert_stream(src: DataFrame, thresholds: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return alerts(src, thresholds, metric, value)


def heartbeat_stream(src: DataFrame, gap: str = "60 seconds", lateness: str = "10 minutes", key: str = "executor_id", ts: str = "ts") -> DataFrame:
    """Spells of reports per executor; the end of a spell is a missed heartbeat.

    With the session settings of this package, sessions merge inside each input
    partition first, so a busy executor does not send every report to one task.
    """
    spells = src.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key)
    out = spells.agg(F.count(F.lit(1)).alias("beats"), F.max(ts).alias("last_seen"))
    return out.select(key, F.col("w.start").alias("spell_start"), F.col("w.end").alias("spell_end"), "beats", "last_seen")


#: Timers need a state store that keeps named state; Spark ships this one.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_SPELLS = "start timestamp, last timestamp, beats bigint"


class _Silence(StatefulProcessor):
    """Open spells of one executor, and one timer at the moment the first of them counts as silent.

    Every call of the state store or of a timer costs a trip to the JVM, so each is made once for a key.
    """

    def __init__(self, gap_ms: int, ts: str, names: list[str]) -> None:
        self.gap, self.ts, self.names = pd.Timedelta(milliseconds=gap_ms), ts, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getListState("spells", _SPELLS)

    def _due(self, last: pd.Timestamp) -> int:
        """The first full millisecond at which ``last`` is a gap ago."""
        micros = (last + self.gap).value // 1000
        return -(-micros // 1000)

    def _known(self) -> list[list]:
        return [[pd.Timestamp(s), pd.Timestamp(e), n] for s, e, n in self.spells.get()]

    def _first(self, spells: list[list]) -> int | None:
        return min((self._due(last) for _, last, _ in spells), default=None)

    def _keep(self, spells: list[list]) -> None:
        if spells:
            self.spells.put([(s.to_pydatetime(), e.to_pydatetime(), n) for s, e, n in spells])
        else:
            self.spells.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        times = [t for frame in rows for t in pd.to_datetime(frame[self.ts]) if t > late]
        known = self._known()
        spells = sorted([*known, *[[t, t, 1] for t in times]], key=lambda x: x[0])
        merged: list[list] = []
        for start, last, beats in spells:
            if merged and start < merged[-1][1] + self.gap:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], last), merged[-1][2] + beats
            else:
                merged.append([start, last, beats])
        if times:
            before, first = self._first(known), self._first(merged)
            if before != first:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(first)
            self._keep(merged)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._known()
        silent = [x for x in at if self._due(x[1]) <= now]
        waiting = [x for x in at if self._due(x[1]) > now]
        if waiting:
            self.handle.registerTimer(self._first(waiting))
        self._keep(waiting)
        if silent:
            rows = [(key[0], start, last, beats, last + self.gap) for start, last, beats in silent]
            yield pd.DataFrame(rows, columns=self.names)

    def close(self) -> None:
        pass


def missed_heartbeats(src: DataFrame, gap_s: float = 60.0, lateness: str = "10 minutes", key: str = "executor_id", ts: str = "ts") -> DataFrame:
    """Executors that fell silent, reported by a timer: no next event of theirs is needed.

    Each key keeps its open spells of reports; a timer at the last report plus
    ``gap_s`` fires once the watermark, ``lateness`` behind the latest event of
    any key, has passed it. Columns: the key, ``spell_start``, ``last_seen``,
    ``beats`` and ``silent_from``. A report that joins or starts a spell within
    the lateness counts in its place; one at or before the watermark with which
    its batch begins is dropped. State and timers survive restarts. An executor
    that never reported has no key, so compare with the list of known ones.
    """
    spark = src.sparkSession
    # Captured by the query when it starts.
    spark.conf.set(*STATE_STORE)
    kind = src.schema[key].dataType.simpleString()
    names = [key, "spell_start", "last_seen", "beats", "silent_from"]
    schema = f"`{key}` {kind}, spell_start timestamp, last_seen timestamp, beats bigint, silent_from timestamp"
    reports = src.select(key, ts).withWatermark(ts, lateness).groupBy(key)
    return reports.transformWithStateInPandas(_Silence(round(gap_s * 1000), ts, names), schema, outputMode="append", timeMode="eventTime")


def metrics_stream(src: DataFrame, spec, keep: list[str]) -> DataFrame:
    """Landed device or executor readings as metric rows."""
    from ..operators.telemetry import to_metrics

    return to_metrics(src, spec, keep)


def stream_run_files(spark: SparkSession, path: str, glob: str = "*.json", max_files: int = 1000, lines: bool = False) -> DataFrame:
    """Each new result file once; the query's checkpoint remembers what was read."""
    reader = spark.readStream.schema(RUN).option("multiLine", str(not lines).lower()).option("pathGlobFilter", glob)
    out = reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).json(path)
    return out.withColumn("_source_file", F.col("_metadata.file_name"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived into a parquet table, then stop."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
