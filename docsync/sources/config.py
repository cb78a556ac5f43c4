"""Configuration, stored as one (kb_id, field, value) row per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync import constants as C


def resolve_config(kv: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One typed row per knowledge base. `names` maps a field to the name it is stored
    under, where that differs."""
    names = names or {}

    def stored(field: str):
        return F.max(F.when(F.col("field") == names.get(field, field), F.col("value"))).alias(field)

    raw = kv.groupBy("kb_id").agg(*[stored(f) for f in C.CONFIG_FIELDS])
    uploads = F.col("max_concurrent_uploads")
    whole = F.when(uploads.rlike(r"^\+?[0-9]+$"), F.expr("try_cast(max_concurrent_uploads AS BIGINT)"))
    # The setting is an unsigned 32-bit number; what lies outside counts as unparsable.
    whole = F.when(whole <= 4294967295, whole)
    typed = {
        "context_header_label": F.coalesce("context_header_label", F.lit(C.DEFAULT_LABEL)),
        "max_concurrent_uploads": F.coalesce(whole, F.lit(C.DEFAULT_UPLOADS).cast("bigint")),
        "convert_to_markdown": F.col("convert_to_markdown").eqNullSafe(F.lit("true")),
    }
    return raw.select(
        "kb_id",
        *[typed.get(f, F.coalesce(f, F.lit(""))).alias(f) for f in C.CONFIG_FIELDS],
    )


def config_rows(config: DataFrame) -> DataFrame:
    """A typed config as the (kb_id, field, value) rows it is stored as."""

    def cell(field: str):
        return F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value"))

    cells = [cell(f) for f in C.CONFIG_FIELDS]
    return config.select("kb_id", F.inline(F.array(*cells)))


def with_default_root(config: DataFrame) -> DataFrame:
    """A sync run falls back to the default root when none is set."""
    root = F.coalesce(F.nullif("target_directory", F.lit("")), F.lit(C.DEFAULT_ROOT))
    return config.withColumn("target_directory", root)


def roots(config: DataFrame) -> DataFrame:
    """The target directory of each knowledge base."""
    return with_default_root(config).select("kb_id", F.col("target_directory").alias("root"))
