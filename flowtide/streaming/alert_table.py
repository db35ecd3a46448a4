"""Alerts kept up to date batch by batch, with the events each batch triggers.

Alerts lie in buckets by key. A batch folds its own alerts into the buckets it touches and writes those as a new
version; a manifest, written last and renamed into place, names the version of every bucket. Readers see the newest
manifest, so a batch becomes visible as a whole. A batch replayed after a failure starts from the manifest before it
and replaces its own version: nothing is counted twice.

Alerts that ended ``settle_minutes`` before the newest event leave their bucket for a folder of the batch, so the
rewritten buckets hold current alerts only. Events older than that open an alert of their own.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.operators.alerts import ESCALATION_LEVELS, KEY, WINDOW_MINUTES, alert_events, alerts, fold_alerts, latest_per_key
from flowtide.sources.sinks import write_batch

_ALERT = ("source_ip string, threat_type string, detection_id bigint, occurrences bigint, first_seen timestamp, last_seen timestamp, "
          "is_acknowledged boolean, bucket int")
_COLUMNS = [c.split()[0] for c in _ALERT.split(", ")]


@dataclass
class AlertTable:
    """A versioned alert table below ``root``."""

    root: str
    window_minutes: float = WINDOW_MINUTES
    buckets: int = 64
    settle_minutes: float | None = None
    levels: Sequence[int] = ESCALATION_LEVELS

    def _files(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, spark: SparkSession, before: int | None = None) -> dict:
        """The newest manifest, or the newest of the batches before one."""
        folder, files = self._files(spark, "manifest")
        known = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        batches = sorted(int(n.split(".")[0]) for n in known if n.endswith(".json"))
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return {"batch": -1, "versions": {}, "newest": None}
        return json.loads(spark.read.text(f"{self.root}/manifest/{batches[-1]}.json", wholetext=True).first()[0])

    def _commit(self, spark: SparkSession, manifest: dict) -> None:
        draft, files = self._files(spark, f"manifest/{manifest['batch']}.draft")
        final, _ = self._files(spark, f"manifest/{manifest['batch']}.json")
        out = files.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        files.delete(final, False)
        files.rename(draft, final)

    def _open(self, spark: SparkSession, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        versions = manifest["versions"]
        paths = [f"{self.root}/open/v={v}/bucket={b}" for b, v in versions.items() if buckets is None or int(b) in buckets]
        if not paths:
            return spark.createDataFrame([], _ALERT)
        return spark.read.schema(_ALERT).option("basePath", f"{self.root}/open").parquet(*paths).select(*_COLUMNS)

    def read(self, spark: SparkSession) -> DataFrame:
        """All alerts as of the newest batch."""
        manifest = self._manifest(spark)
        rows = self._open(spark, manifest)
        folder, files = self._files(spark, "settled")
        if files.exists(folder):
            settled = spark.read.schema(_ALERT + ", batch_id bigint").parquet(f"{self.root}/settled")
            rows = rows.unionByName(settled.filter(F.col("batch_id") <= manifest["batch"]).select(*_COLUMNS))
        return rows.drop("bucket")

    def events(self, spark: SparkSession) -> DataFrame:
        """NEW and ESCALATION events of all batches up to the newest."""
        return spark.read.parquet(f"{self.root}/events").filter(F.col("batch_id") <= self._manifest(spark)["batch"])

    def update(self, rows: DataFrame, batch_id: int) -> None:
        """Fold a batch of alertable detections (source_ip, threat_type, created_at, id) into the table and write the
        events it triggers. Only slot summaries and the first rows of a slot leave a task."""
        spark = rows.sparkSession
        timed = rows.withColumn("created_at", F.col("created_at").cast("timestamp"))
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        fresh = alerts(timed, self.window_minutes).withColumn("bucket", bucket).persist()
        manifest = self._manifest(spark, batch_id)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        stored = self._open(spark, manifest, touched)
        known = latest_per_key(stored.drop("bucket"))
        write_batch(alert_events(timed, self.window_minutes, tuple(self.levels), known), f"{self.root}/events", batch_id)
        folded = fold_alerts(stored.drop("bucket"), fresh.drop("bucket"), self.window_minutes).withColumn("bucket", bucket)
        newest = fresh.agg(F.unix_micros(F.max("last_seen"))).first()[0]
        newest = max((n for n in (newest, manifest["newest"]) if n is not None), default=None)
        if self.settle_minutes is not None and newest is not None:
            folded = folded.persist()
            done = F.unix_micros("last_seen") < newest - int(self.settle_minutes * 60_000_000)
            write_batch(folded.filter(done).select(*_COLUMNS), f"{self.root}/settled", batch_id)
            self._write(folded.filter(~done), batch_id)
            folded.unpersist()
        else:
            self._write(folded, batch_id)
        fresh.unpersist()
        written = self._written(spark, batch_id)
        # A touched bucket whose alerts have all settled has no version any more.
        kept = {b: v for b, v in manifest["versions"].items() if int(b) not in touched}
        self._commit(spark, {"batch": batch_id, "newest": newest, "versions": kept | {str(b): batch_id for b in touched if b in written}})

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*_COLUMNS).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/open/v={batch_id}")

    def _written(self, spark: SparkSession, batch_id: int) -> set[int]:
        folder, files = self._files(spark, f"open/v={batch_id}")
        return {int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder) if s.getPath().getName().startswith("bucket=")}

    def vacuum(self, spark: SparkSession, keep: int = 10) -> None:
        """Remove versions that none of the newest ``keep`` manifests names, and older manifests."""
        folder, files = self._files(spark, "manifest")
        batches = sorted(int(s.getPath().getName().split(".")[0]) for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        used = {v for b in batches[-keep:] for v in self._manifest(spark, b + 1)["versions"].values()}
        for b in batches[:-keep]:
            if b not in used:
                files.delete(self._files(spark, f"open/v={b}")[0], True)
            files.delete(self._files(spark, f"manifest/{b}.json")[0], False)
