"""From raw documents to packed training windows: five stages, each written as Parquet and read by the next.

1. quality: documents that the classifier rejects go (learnt from ``labels`` that are not held out).
2. near_duplicates: of each class of texts at 0.8 or more, the document with the least doc_id stays.
3. decontamination: documents that hold a passage of ``benchmark`` go.
4. pii: personal data and secrets are replaced by surrogates; ``n_chars`` follows the new text.
5. packing: one row per piece of a training window.

All stages but the last return the columns they got. Documents with null or empty text pass stages 2 to 4 and are a
single end token in the last; the classifier decides on them like on any other.

A stage stores frames below the checkpoint folder; they go when the next stage begins, unless its ``docs`` read them.
So a stage's result has to be written, or done with, before another stage is called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm import decontaminate, jaccard_join, packing, pii, quality
from flowtide.llm.common import numbered, scratch_path, small, table, unpacked
from flowtide.llm.queries import PII_KEY, byte_vocabulary
from flowtide.session import next_scope, remove_folder


def _stage(function: Callable) -> Callable:
    """A stage that first removes what the one before it stored."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        next_scope(spark, docs)
        return function(spark, docs, sf_dir)
    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(quality.describe(docs), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


@_stage
def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, "stage-rows")
    classes = jaccard_join.near_duplicates(rows.select("rid", "row.doc_id", "row.text"))
    others = classes.filter(F.col("rid") != F.col("first_rid")).select("rid")
    return unpacked(rows.join(small(others, "stage-others"), "rid", "left_anti"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs, "stage-rows")
    found = decontaminate.contamination(rows.select("rid", "row.doc_id", "row.text"), table(spark, sf_dir, "benchmark"))
    return unpacked(rows.join(found.filter("contaminated").select("rid"), "rid", "left_anti"))


@_stage
def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymized(docs, PII_KEY).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *byte_vocabulary())


STAGES = [("quality", keep_good), ("near_duplicates", keep_first), ("decontamination", drop_contaminated), ("pii", replace_private), ("packing", pack)]

#: A fitted kernel classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    next_scope(spark, opened=False)
    paths = [scratch_path(spark, f"pipeline-{name}") for name, _ in STAGES]
    docs = table(spark, sf_dir, "documents")
    for k, (path, (_, stage)) in enumerate(zip(paths, STAGES, strict=True)):
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove_folder(spark, paths[k - 1])
    next_scope(spark, docs, opened=False)
    return docs
