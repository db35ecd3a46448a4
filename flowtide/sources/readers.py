"""Scans: flow CSVs, labelled training folders, reports, sidecars, log text, streams."""

from __future__ import annotations

import csv
import json
from collections import Counter
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowtide.functions.scalars import slash_names
from flowtide.operators import align, evaluate
from flowtide.schemas import col
from flowtide.sources.sinks import exists, listed


class EmptyInput(ValueError):
    """The file or frame holds no rows, or cannot be read."""


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-text scan with a trimmed header. Types are settled later, per cell, without failing."""
    try:
        df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True,
                            ignoreTrailingWhiteSpace=True, enforceSchema=False)
    except AnalysisException as exc:
        raise EmptyInput(f"cannot read {path}: {exc}") from exc
    if not df.columns:
        raise EmptyInput(f"{path} has no header")
    return align.trim_header(df)


def read_flows(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Flow records of a CSV file or folder, ready for alignment."""
    df = read_csv(spark, path)
    if df.isEmpty():
        raise EmptyInput(f"{path} holds no rows")
    return align.flows_from_frame(df, max_rows)


def flows_of(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The same for a frame already at hand."""
    if df.isEmpty():
        raise EmptyInput("the frame holds no rows")
    return align.flows_from_frame(df, max_rows)


_BAD_LINE = "_bad_line"
_REJECTS = "file string, reason string, line string"


def _header(line: str) -> list[str]:
    """Trimmed titles; a repeated one gets its position, so that every column has a name of its own."""
    titles = [t.strip() for t in next(csv.reader([line.lstrip("\ufeff")]))]
    return [t if t and titles.count(t) == 1 else f"{t}{i}" for i, t in enumerate(titles)]


def _first_lines(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """The first line of every file, by one job over all of them.

    The least line number of a file is found first, which takes a hash table of the files alone: aggregating the lines
    themselves would sort all of a task's lines. Both readings of the same files number their lines alike.
    """
    lines = (spark.read.text(list(files)).select("value", "_metadata.file_path", "_metadata.file_block_start")
             .filter("file_block_start = 0").withColumn("at", F.monotonically_increasing_id()))
    firsts = lines.groupBy("file_path").agg(F.min("at").alias("at")).select("at")
    return {unquote(r["file_path"]): r["value"] for r in lines.join(F.broadcast(firsts), "at").select("file_path", "value").collect()}


def scan_labelled(spark: SparkSession, paths: Sequence[str], label: str = "Label") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of labelled CSV files, merged by column name; nothing is lost on the way.

    Every data line of a file is a row or a reject (file, reason, line); blank lines and repeats of the header are no data. Rejected are lines that don't fit their file's
    header, all lines of a file without the label column, and, with a null line, files that are missing or empty.
    Feature cells that are not numbers become null. A path given twice counts twice.
    """
    rejected: list[tuple[str, str, None]] = []
    layouts: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for times, group in _by_times(paths):
        there = [p for p in group if exists(spark, p)]
        rejected += [(p, "missing", None) for p in group if p not in there] * times
        if not there:
            continue
        sizes = dict(f for p in there for f in listed(spark, p))
        rejected += [(f, "empty", None) for f, size in sizes.items() if not size] * times
        filled = [f for f, size in sizes.items() if size]
        for file, line in (_first_lines(spark, filled) if filled else {}).items():
            layouts.setdefault(tuple(_header(line)), []).extend([(file, line)] * times)
    rows, rejects = None, spark.createDataFrame(rejected, _REJECTS)
    # One scan per distinct header, so thousands of like files stay one scan.
    for columns, files in layouts.items():
        lines = (spark.read.text([f for f, _ in files]).select("value", F.col("_metadata.file_path").alias("file"))
                 .filter((F.trim("value") != "") & ~F.col("value").isin(sorted({line for _, line in files}))))
        if label in columns:
            fields = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, _BAD_LINE)])
            cells = F.from_csv("value", fields.toDDL(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD_LINE,
                                                         "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
            parsed = lines.withColumn("cells", cells)
            fits = F.col(f"cells.{_BAD_LINE}").isNull()
            good, lines = parsed.filter(fits).select(*[F.col(f"cells.`{c}`").alias(c) for c in columns]), parsed.filter(~fits)
            rows = good if rows is None else rows.unionByName(good, allowMissingColumns=True)
            reason = "does not fit the header"
        else:
            reason = f"no column {label}"
        rejects = rejects.unionByName(lines.select("file", F.lit(reason).alias("reason"), F.col("value").alias("line")))
    if rows is None:
        raise EmptyInput("no usable file: " + "; ".join(f"{p}: {why}" for p, why, _ in rejected) + f"; {len(layouts)} headers lack {label}")
    return typed(rows, label), rejects


def _by_times(paths: Sequence[str]) -> list[tuple[int, list[str]]]:
    """Distinct paths, grouped by how often they are given."""
    groups: dict[int, list[str]] = {}
    for path, times in Counter(paths).items():
        groups.setdefault(times, []).append(path)
    return list(groups.items())


def read_labelled(spark: SparkSession, paths: Sequence[str], label: str = "Label") -> DataFrame:
    """The rows of ``scan_labelled``; having none is an error."""
    return scan_labelled(spark, paths, label)[0]


def labelled_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder. Only names are listed."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
        return sorted(unquote(r[0]) for r in found.select("path").collect())
    except AnalysisException as exc:
        raise EmptyInput(f"cannot list {folder}: {exc}") from exc


def read_labelled_folder(spark: SparkSession, folder: str, label: str = "Label") -> DataFrame:
    """Every CSV file of a folder, merged as above."""
    return read_labelled(spark, labelled_files(spark, folder), label)


def typed(df: DataFrame, label: str = "Label") -> DataFrame:
    """Everything but the label as double; the label trimmed and repaired."""
    return df.select(*[align.as_double(col(c)).alias(c) for c in df.columns if c != label],
                     slash_names(F.trim(col(label).cast("string"))).alias(label))


def label_pool(df: DataFrame, keep: Sequence[str], order_by: Sequence[str], max_rows: int = 20_000,
               label: str = "Label") -> DataFrame:
    """Rows of the wanted labels, the first ``max_rows`` in the stated order."""
    wanted = df.filter(F.trim(col(label)).isin(list(keep)))
    return wanted.orderBy(*[col(c) for c in order_by]).limit(max_rows)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def flow_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Flow rows arriving as files. Any other streaming source yields the same rows."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def exporter_features(df: DataFrame) -> DataFrame:
    """Flow-exporter rows at the capture boundary: ports stay features, other identity columns are
    split off, anything that is not a number counts as 0."""
    identity = {"src_ip", "dst_ip", "protocol", "timestamp"}
    text = [F.trim(F.coalesce(col(c).cast("string"), F.lit(""))).alias(c) for c in ("src_ip", "dst_ip")]
    features = [align.safe_float(col(c)).alias(c) for c in df.columns
                if c not in identity and c not in ("src_port", "dst_port")]
    ports = [align.safe_int(col(c)).alias(c) for c in ("src_port", "dst_port", "protocol")]
    return df.select(*text, *ports, *features)


# --- evaluation reports and model sidecars ---------------------------------------------------

REPORT_ROWS = ("accuracy", "macro avg", "weighted avg")


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """A small JSON document (metadata, metrics) on the shared file system."""
    row = spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """The document back, or an empty one when it is missing."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException:
        return {}
    return json.loads(rows[0][0]) if rows else {}


def write_sidecar(spark: SparkSession, path: str, features: Sequence[str], model_type: str,
                  version: str, classes: Sequence[str] = (), scaler: dict | None = None) -> None:
    write_json(spark, {"feature_names": list(features), "model_type": model_type, "version": version,
                       "classes": list(classes), "scaler": scaler or {}}, path)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """Feature names, classes and scaler of a model. A scaler's own feature order wins."""
    meta = read_json(spark, path)
    names = list(meta.get("scaler") or {}) or meta.get("feature_names", [])
    classes = [c.replace("�", "/") for c in meta.get("classes", [])]
    if not names:
        raise ValueError(f"{path} names no features")
    return {**meta, "feature_names": names, "classes": classes}


def report_frame(spark: SparkSession, report: dict, model: str) -> DataFrame:
    """One model's evaluation entry as tidy class rows (class, precision, recall, f1, support)."""
    rows = [(model, name.replace("�", "/"), float(v.get("precision", 0)), float(v.get("recall", 0)),
             float(v.get("f1-score", 0)), float(v.get("support", 0)))
            for name, v in report.items() if isinstance(v, dict) and name not in REPORT_ROWS]
    return spark.createDataFrame(
        rows, "model string, class string, precision double, recall double, f1 double, support double")


def matrix_frame(spark: SparkSession, matrix: Sequence[Sequence[int]], classes: Sequence[str]) -> DataFrame:
    """A stored confusion matrix in long form."""
    rows = [(a, p, int(n)) for a, line in zip(classes, matrix) for p, n in zip(classes, line)]
    return spark.createDataFrame(rows, "actual string, predicted string, n bigint")


def evaluation_payload(long: DataFrame, classes: Sequence[str]) -> dict:
    """Metrics of one model as a JSON-ready document. Collects classes-squared cells only."""
    report = evaluate.class_report(long)
    entries = {r["class"]: {"precision": r["precision"], "recall": r["recall"], "f1-score": r["f1"],
                            "support": float(r["support"])} for r in report.collect()}
    for r in evaluate.report_averages(report).collect():
        entries[r["average"]] = {"precision": r["precision"], "recall": r["recall"],
                                 "f1-score": r["f1"], "support": float(r["support"])}
    totals = evaluate.overall(long).first()
    cells = {(r["actual"], r["predicted"]): r["n"] for r in long.collect()}
    return {"accuracy": totals["accuracy"], "mcc": totals["mcc"], "report": entries,
            "confusion_matrix": [[int(cells.get((a, p), 0)) for p in classes] for a in classes]}
