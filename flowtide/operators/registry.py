"""Small catalogue tables: models, subscribers, list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.operators.skew import lookup


def resolve_model_name(df: DataFrame, models: DataFrame, model_id: str = "model_id",
                       prefix: str = "unresolved_model_") -> DataFrame:
    """Add ``model_name``; unknown ids get a placeholder text."""
    names = models.groupBy(F.col("id").alias(model_id)).agg(F.min("name").alias("model_name"))
    return lookup(df, names, model_id).withColumn(
        "model_name", F.coalesce("model_name", F.concat(F.lit(prefix), F.col(model_id).cast("string"))))


def register(models: DataFrame, additions: DataFrame) -> DataFrame:
    """Add models under new names; a name already taken is an error. Additions are the few rows an
    operator registers at once, so numbering them in one window is fine."""
    clash = additions.join(models.select("name"), "name", "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"model name already registered: {clash[0]['name']}")
    start = models.agg(F.coalesce(F.max("id"), F.lit(0)))
    order = F.row_number().over(Window.orderBy("name"))
    fresh = additions.withColumn("id", (start.scalar() + order).cast("long"))
    return models.unionByName(fresh, allowMissingColumns=True)


def active(models: DataFrame) -> DataFrame:
    return models.filter("is_active").orderBy("id")


def activate(models: DataFrame, model_id: int, exclusive: bool = True) -> DataFrame:
    """Set one model active; exclusively means all others become inactive."""
    others = F.lit(False) if exclusive else F.col("is_active")
    return models.withColumn("is_active", F.when(F.col("id") == model_id, True).otherwise(others))


def deactivate(models: DataFrame, model_id: int | None = None) -> DataFrame:
    hit = F.lit(True) if model_id is None else F.col("id") == model_id
    return models.withColumn("is_active", F.col("is_active") & ~hit)


def macro_model(models: DataFrame, configured: int | None = None) -> DataFrame:
    """The macro classifier: the configured id if present, else the newest record whose name or
    path mentions ``macro``; no row when there is none."""
    named = F.lower(F.concat_ws(" ", "name", "file_path")).contains("macro")
    preferred = F.col("id") == configured if configured else F.lit(False)
    return (models.withColumn("_rank", F.when(preferred, 0).when(named, 1))
            .filter("_rank IS NOT NULL").orderBy("_rank", F.desc("id")).limit(1).drop("_rank"))


def edit(entries: DataFrame, key: str, value: object, **changes: Column) -> DataFrame:
    """Change columns of the row with ``key == value``; an absent key is an error."""
    if entries.filter(F.col(key) == value).limit(1).count() == 0:
        raise KeyError(f"no row with {key} = {value}")
    hit = F.col(key) == value
    return entries.withColumns({c: F.when(hit, new).otherwise(F.col(c)) for c, new in changes.items()})


def delete(entries: DataFrame, key: str, value: object) -> DataFrame:
    return entries.filter((F.col(key) != value) | F.col(key).isNull())


def by_key(entries: DataFrame, key: str, value: object) -> DataFrame:
    return entries.filter(F.col(key) == value).orderBy("id")


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("id"))


def status(models: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals and active counts of models and alerts."""
    m = models.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"))
    a = alerts.agg(F.count(F.lit(1)).alias("total"),
                   F.count_if(~F.col("is_acknowledged")).alias("active"))
    return (m.select(F.lit("models").alias("item"), "total", "active")
            .union(a.select(F.lit("alerts").alias("item"), "total", "active")))
