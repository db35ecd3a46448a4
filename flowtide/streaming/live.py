"""The live pipeline: one micro-batch writes raw rows, verdicts, logs and alerts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowtide.operators import alerts, align, decide, reports
from flowtide.plans.audit import Reputation, detect, detection_rows
from flowtide.plans.models import FlowModel
from flowtide.schemas import col
from flowtide.session import scratch_path
from flowtide.sources.sinks import exists, folder_bytes, write_batch
from flowtide.streaming.alert_table import AlertTable

FLUSH_SECONDS = 10


@dataclass
class LivePipeline:
    """Scores flow micro-batches and appends to the tables below ``root``.

    ``id_col`` is a unique flow id and ``time_col`` the event time. Every table is written in one
    folder per batch, so a batch replayed after a failure replaces itself.
    """

    model: FlowModel
    root: str
    lists: Reputation = field(default_factory=Reputation)
    source_type: str = "live"
    id_col: str = "flow_id"
    time_col: str = "created_at"
    min_coverage: float = 0.5
    late_after_seconds: float | None = None
    window_minutes: float = alerts.WINDOW_MINUTES

    @property
    def alert_table(self) -> AlertTable:
        return AlertTable(self.path("alerts"), self.window_minutes)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Clean, score and persist one micro-batch."""
        spark = batch.sparkSession
        if self.late_after_seconds is not None:
            batch = self._set_late_aside(batch, batch_id)
        # Kept for the batch's few reads; a lost executor's share is read again from the source.
        flows = align.sanitize(align.flows_from_frame(batch, keep=[self.id_col, self.time_col])).persist()
        scored, rejected = detect(flows, self.model, self.source_type, [self.id_col, self.time_col], self.lists,
                                  self.min_coverage)
        rows = detection_rows(scored, self.model.features, self.id_col, self.time_col)
        write_batch(rows, self.path("detections"), batch_id)
        # Later tables read the stored verdicts, so the model runs once per flow.
        stored = spark.read.parquet(f"{self.path('detections')}/batch_id={batch_id}")
        verdicts = stored.select(F.col("id").alias(self.id_col), "prediction", "confidence", "attack_type")
        write_batch(flows.join(verdicts, self.id_col, "left"), self.path("cleaned"), batch_id)
        write_batch(rejected, self.path("rejected"), batch_id)
        write_batch(decide.audit_log(stored), self.path("logs"), batch_id)
        write_batch(alerts.alertable(stored), self.path("alertable"), batch_id)
        self.alert_table.update(spark.read.parquet(f"{self.path('alertable')}/batch_id={batch_id}"), batch_id)
        flows.unpersist()

    def _set_late_aside(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows older than the newest event of earlier batches minus the allowance go to the
        ``late`` table instead of being scored; none is lost."""
        spark = batch.sparkSession
        # Each batch stores the newest event of itself and all before it, so the next one reads a single row.
        edge = None
        if batch_id and exists(spark, f"{self.path('progress')}/batch_id={batch_id - 1}"):
            edge = spark.read.schema("newest timestamp").parquet(f"{self.path('progress')}/batch_id={batch_id - 1}").first()[0]
        newest = F.greatest(F.max(F.col(self.time_col).cast("timestamp")), F.lit(edge).cast("timestamp")).alias("newest")
        write_batch(batch.agg(newest), self.path("progress"), batch_id)
        if edge is None:
            return batch
        allowed = F.lit(edge) - F.make_dt_interval(secs=F.lit(float(self.late_after_seconds)))
        on_time, late = late_rows(batch, self.time_col, allowed)
        write_batch(late, self.path("late"), batch_id)
        return on_time

    def start(self, stream: DataFrame, once: bool = False, seconds: int = FLUSH_SECONDS) -> StreamingQuery:
        """Run the scoring query; ``once`` drains what is there and stops."""
        writer = (stream.writeStream.queryName("live-scoring").foreachBatch(self.process)
                  .option("checkpointLocation", f"{self.root}/_checkpoints/scoring"))
        return (writer.trigger(availableNow=True) if once
                else writer.trigger(processingTime=f"{seconds} seconds")).start()

    def start_raw(self, stream: DataFrame, once: bool = False, seconds: int = FLUSH_SECONDS) -> StreamingQuery:
        """Keep raw rows, untouched, in a query of their own: they persist even while scoring is
        stopped."""
        writer = (observed(stream).writeStream.queryName("live-raw").format("parquet").outputMode("append")
                  .option("path", self.path("raw"))
                  .option("checkpointLocation", f"{self.root}/_checkpoints/raw"))
        return (writer.trigger(availableNow=True) if once
                else writer.trigger(processingTime=f"{seconds} seconds")).start()

    def alerts(self, spark: SparkSession) -> DataFrame:
        """Alerts over everything stored so far, as folded batch by batch."""
        return self.alert_table.read(spark)

    def stored_bytes(self, spark: SparkSession) -> dict[str, int]:
        """Bytes of each table below ``root``."""
        return {t: folder_bytes(spark, self.path(t)) for t in ("raw", "cleaned", "detections", "logs", "rejected", "late")}

    def recent(self, spark: SparkSession, limit: int = 100) -> DataFrame:
        """Newest live results, newest first."""
        return reports.recent(spark.read.parquet(self.path("detections")), limit).select(
            "created_at", "source_ip", "destination_ip", "model_name", "prediction", "confidence", "severity",
            "attack_type", "attack_reason", "is_whitelisted", "is_blacklisted")


class Progress(StreamingQueryListener):
    """Counters of one named query, kept up to date by its events: rows in, what ``observed`` counted, batches, backlog
    and the last error. Add it with ``spark.streams.addListener``."""

    def __init__(self, name: str):
        self.name, self._ids = name, set()
        self.batches: dict[int, tuple[int, dict[str, int]]] = {}
        self.rows_per_second, self.backlog, self.last_error, self.is_running = 0.0, {}, None, False

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._ids.add(str(event.id))
            self.is_running = True

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        observed = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
        # By batch, so that a batch that runs again counts once.
        self.batches[p.batchId] = (p.numInputRows, observed)
        self.rows_per_second = p.processedRowsPerSecond
        self.backlog = {k: v for source in p.sources for k, v in dict(source.metrics or {}).items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self._ids:
            self.is_running, self.last_error = False, event.exception

    def counters(self) -> dict:
        """All batches together."""
        totals = Counter()
        for rows, observed in self.batches.values():
            totals.update({"input_rows": rows, **{k: v or 0 for k, v in observed.items()}})
        return {**totals, "batches": sum(rows > 0 for rows, _ in self.batches.values()), "rows_per_second": self.rows_per_second,
                "backlog": self.backlog, "is_running": self.is_running, "last_error": self.last_error}


def observed(stream: DataFrame, name: str = "live") -> DataFrame:
    """Let the listener count what passes: flows, and the packets in them where the stream has packet totals. It belongs
    on a query that reads a batch once, as the raw one does; scoring reads it for every table."""
    packets = [c for c in ("Total Fwd Packets", "Total Backward Packets") if c in stream.columns]
    total = sum((F.coalesce(F.sum(col(c)), F.lit(0)) for c in packets), F.lit(0))
    return stream.observe(name, F.count(F.lit(1)).alias("flows"), total.cast("long").alias("packets"))


def progress(query: StreamingQuery) -> dict:
    """Counters of a running query: rows in, batches, backlog and last error."""
    last = query.lastProgress
    error = query.exception()
    return {"is_running": query.isActive, "batch_id": last["batchId"] if last else None,
            "input_rows": sum(p["numInputRows"] for p in query.recentProgress),
            "rows_per_second": last["processedRowsPerSecond"] if last else 0.0,
            "last_error": str(error) if error else None}


def late_rows(batch: DataFrame, time_col: str, watermark) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch relative to a watermark."""
    late = F.coalesce(F.col(time_col) < watermark, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def drain(stream: DataFrame, label: str, feeds: Iterable[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """Run an append-mode query over what its source holds and read the result table back. ``feeds`` add to the source;
    the query goes on after each of them, from its checkpoint."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    for feed in feeds:
        feed()
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
                 .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_batches(stream: DataFrame, label: str, process: Callable[[DataFrame, int], None],
                  feeds: Iterable[Callable[[], None]] = (lambda: None,)) -> None:
    """Like ``drain``, with ``process`` called on every micro-batch."""
    base = scratch_path(stream.sparkSession, label)
    for feed in feeds:
        feed()
        stream.writeStream.foreachBatch(process).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()
