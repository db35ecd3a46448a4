"""Flow preparation: identity, feature alignment, coverage and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowtide.functions import naming
from flowtide.schemas import IDENTITY_COLUMNS, col

# --- Fixed values: columns that are never features. ---
NON_FEATURES = frozenset({"label", "timestamp", "flow id", "prediction", "confidence", "severity"})

UNKNOWN_ADDRESS = "Unknown"


def as_double(value: Column) -> Column:
    return value.try_cast("double")


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; null for null."""
    return ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))


def safe_int(value: Column) -> Column:
    """``int(float(x))`` with 0 for anything that does not parse."""
    number = as_double(value)
    return F.coalesce(F.when(is_finite(number), number).try_cast("int"), F.lit(0))


def safe_float(value: Column) -> Column:
    return F.coalesce(as_double(value), F.lit(0.0))


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def feature_columns(df: DataFrame, identity: dict[str, str | None]) -> list[str]:
    """Columns that may carry features: everything but addresses and bookkeeping columns, and
    only numeric or still-untyped (string) ones."""
    skip = {identity.get("src_ip"), identity.get("dst_ip")}
    return [f.name for f in df.schema.fields
            if f.name not in skip and f.name.strip().lower() not in NON_FEATURES
            and isinstance(f.dataType, (T.NumericType, T.StringType))]


def flows_from_frame(df: DataFrame, max_rows: int | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Identity columns plus one double column per feature.

    Addresses are trimmed with ``Unknown`` for null, ports and protocol default to 0. A cell
    that is null, NaN or not a number is absent (null). ``max_rows`` of 0 or None keeps all.
    """
    df = trim_header(df)
    if max_rows and max_rows > 0:
        df = df.limit(max_rows)
    found = naming.identity_columns(df.columns)

    def text(field: str) -> Column:
        name = found[field]
        value = F.trim(col(name).cast("string")) if name else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(UNKNOWN_ADDRESS)).alias(field)

    def number(field: str) -> Column:
        name = found[field]
        return (safe_int(col(name)) if name else F.lit(0)).alias(field)

    identity = [text("src_ip"), text("dst_ip"), number("src_port"), number("dst_port"),
                number("protocol")]
    features = []
    for name in feature_columns(df, found):
        if name.lower() in IDENTITY_COLUMNS or name in keep:
            continue
        value = as_double(col(name))
        features.append(F.when(~F.isnan(value), value).alias(name))
    return df.select(*[col(k) for k in keep], *identity, *features)


def align(df: DataFrame, required: Sequence[str], keep: Sequence[str] = (), fill: float = 0.0,
          report: str = "row") -> DataFrame:
    """Project ``df`` onto the model's ordered features.

    ``report="row"``: each required feature takes the first non-null of its candidate columns.
    ``"frame"``: the best candidate column alone supplies the feature, and its nulls become
    ``fill``. Non-finite values become ``fill``. ``"row"`` adds ``missing_features`` and ``coverage`` judged per row
    (absent or null); ``"frame"`` judges by column existence only.
    """
    sources = naming.resolve([c for c in df.columns if c not in keep], required)
    values, absent = [], []
    for name in required:
        candidates = [as_double(col(c)) for c in sources[name]]
        if not candidates:
            values.append(F.lit(float(fill)).alias(name))
            absent.append(F.lit(name))
            continue
        usable = [F.when(~F.isnan(c), c) for c in candidates]
        first = F.coalesce(*usable) if len(usable) > 1 and report == "row" else usable[0]
        values.append(F.when(is_finite(first), first).otherwise(F.lit(float(fill))).alias(name))
        if report == "row":
            absent.append(F.when(first.isNull(), F.lit(name)))
    out = df.select(*[col(k) for k in keep], *values, *_missing(absent).values())
    share = F.size("missing_features") / F.lit(float(max(len(required), 1)))
    return out.withColumn("coverage", F.lit(1.0) - share)


def _missing(absent: list[Column]) -> dict[str, Column]:
    if not absent:
        return {"missing": F.array().cast("array<string>").alias("missing_features")}
    return {"missing": F.array_compact(F.array(*absent)).alias("missing_features")}


def covered(aligned: DataFrame, minimum: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Split aligned rows into (accepted, rejected) by feature coverage."""
    enough = F.col("coverage") >= F.lit(minimum)
    return aligned.filter(enough), aligned.filter(~enough)


def sanitize(df: DataFrame) -> DataFrame:
    """Numeric null, NaN and infinities become 0; other columns pass through."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = col(f.name)
            out.append(F.when(is_finite(c), c).otherwise(F.lit(0.0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(col(f.name), F.lit(0).cast(f.dataType)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def drop_unusable(df: DataFrame) -> DataFrame:
    """Training rows only: any null, NaN or infinity drops the row."""
    condition = F.lit(True)
    for f in df.schema.fields:
        c = col(f.name)
        condition &= c.isNotNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            condition &= is_finite(c)
    return df.filter(condition)


def _supplies(key: Column, required: Sequence[str]) -> Column:
    """Whether a key can supply one of the required names: the name resolution as an expression."""
    wanted = {c for name in required for c in naming.lookups(name)}
    direct = sorted(wanted | {s for s, c in naming.FEATURE_CLASS.items() if c in wanted})
    worded = sorted({k for name in required for k in (naming.canonical(name), naming.squeeze(name))})
    words = F.regexp_extract_all(F.lower(F.regexp_replace(key, r"[\s_.\-/]+", "_")), F.lit(r"(\d+|[^\d_]+)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in naming.WORD_CLASS.items() for x in pair])
    canonical = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")
    plain = F.lower(F.regexp_replace(key, r"[\s_.\-/]+", ""))
    return plain.isin(direct) | plain.isin(worded) | canonical.isin(worded)


def align_json(df: DataFrame, json_col: str, required: Sequence[str], keep: Sequence[str] = (),
               fill: float = 0.0) -> DataFrame:
    """Align feature objects stored as JSON text, one object per row.

    Keys that can supply none of the required names are dropped where they are read, however many there are. The
    spellings left, variants of the required names, are resolved on the driver; values never leave the executors.
    """
    # Texts first, so that one value which is no number leaves the others readable.
    texts = F.from_json(col(json_col), "map<string,string>")
    bag = F.transform_values(texts, lambda k, v: v.try_cast("double"))
    parsed = df.withColumn("_bag", bag)
    names = parsed.select(F.explode(F.map_keys("_bag")).alias("k")).distinct()
    spelled = sorted(r[0] for r in names.filter(_supplies(F.col("k"), required)).collect())
    wide = parsed.select(*[col(k) for k in keep],
                         *[F.col("_bag").getItem(s).alias(f"f:{i}") for i, s in enumerate(spelled)])
    back = {s: f"f:{i}" for i, s in enumerate(spelled)}
    sources = naming.resolve(spelled, required)
    values, absent = [], []
    for name in required:
        picks = [col(back[s]) for s in sources[name]]
        if not picks:
            values.append(F.lit(float(fill)).alias(name))
            absent.append(F.lit(name))
            continue
        first = F.coalesce(*picks)
        values.append(F.when(is_finite(first), first).otherwise(F.lit(float(fill))).alias(name))
        absent.append(F.when(first.isNull(), F.lit(name)))
    out = wide.select(*[col(k) for k in keep], *values, *_missing(absent).values())
    return out.withColumn("coverage",
                          F.lit(1.0) - F.size("missing_features") / F.lit(float(len(required) or 1)))
