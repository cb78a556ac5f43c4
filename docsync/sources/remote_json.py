"""Relations read from the JSON bodies a knowledge-base service returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.operators.skew import broadcast_if_small, set_down

FILES = "files array<struct<id string, filename string>>"
KB = "struct<id string, name string, description string>"


def parse_kb_files(bodies: DataFrame) -> DataFrame:
    """Files of each `(kb_id, body)`, in list order.

    A listing may be split over several bodies; `first_pos` then says at which
    position of the whole listing a body starts.
    """
    start = F.col("first_pos") if "first_pos" in bodies.columns else F.lit(0)
    parsed = bodies.select("kb_id", start.alias("_start"), F.from_json("body", FILES).alias("b"))
    rows = parsed.select("kb_id", "_start", F.posexplode("b.files").alias("_i", "f"))
    return rows.filter(F.col("f.id").isNotNull()).select(
        "kb_id",
        (F.col("_start") + F.col("_i")).cast("bigint").alias("pos"),
        F.col("f.id").alias("remote_file_id"),
        F.coalesce("f.filename", F.lit("")).alias("filename"),
    )


def parse_kb_catalog(bodies: DataFrame) -> DataFrame:
    """Knowledge bases of each `body`: an object with `items`, else a bare array.
    Entries without an id, and bodies of neither shape, give no row."""
    # A bare array also reads as a one-field object, so the first character decides.
    is_array = F.startswith(F.ltrim(F.col("body"), F.lit(" \t\r\n")), F.lit("["))
    items = F.from_json("body", f"items array<{KB}>")["items"]
    flat = F.from_json("body", f"array<{KB}>")
    return (
        bodies.select(F.inline(F.when(is_array, flat).otherwise(items)))
        .filter(F.col("id").isNotNull())
        .select(
            "id",
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce("description", F.lit("")).alias("description"),
        )
    )


def parse_upload_resp(bodies: DataFrame) -> DataFrame:
    """Add `remote_file_id`, null when the body carries no id."""
    return bodies.withColumn("remote_file_id", F.get_json_object("body", "$.id"))


def _read(body: str) -> tuple[Column, Column]:
    """A JSON body as a variant, null when it is not JSON, and whether it is an object."""
    parsed = F.try_parse_json(body)
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return parsed, F.coalesce(is_object, F.lit(False))


def parse_status(bodies: DataFrame) -> DataFrame:
    """Add `status`, null when the body has none, and `body_ok`, false for a body that is no
    JSON object or whose status is no text. With a `code` column also `answered`, whether
    the service gave a 2xx answer at all."""
    parsed, is_object = _read("body")
    field = F.try_variant_get(parsed, "$.status", "variant")
    kind = F.coalesce(F.schema_of_variant(field), F.lit("VOID"))
    out = bodies.withColumn("body_ok", is_object & kind.isin("STRING", "VOID"))
    out = out.withColumn("status", F.when(F.col("body_ok"), F.try_variant_get(parsed, "$.status", "string")))
    if "code" in bodies.columns:
        out = out.withColumn("answered", F.coalesce(F.col("code").between(200, 299), F.lit(False)))
    return out


def _kind(entry: Column, field: str) -> Column:
    """Type of a field of a JSON object, VOID for a JSON null, null where there is none."""
    return F.schema_of_variant(F.try_variant_get(entry, f"$.{field}", "variant"))


def _refusal(entries: Column, texts: list[str]) -> Column:
    """Why a list of entries is refused whole: each needs a text `id`, and `texts` are texts if present."""
    has_id = lambda e: F.coalesce(_kind(e, "id"), F.lit("VOID")) != "VOID"

    def well_formed(e):
        kinds = [F.coalesce(_kind(e, f), F.lit("STRING")) == "STRING" for f in ["id", *texts]]
        ok = kinds[0]
        for kind in kinds[1:]:
            ok = ok & kind
        return ok

    return F.when(~F.forall(entries, has_id), "no_id").when(~F.forall(entries, well_formed), "bad_entry")


def rejected_bodies(bodies: DataFrame, entries: str = "files") -> DataFrame:
    """Those of the (kb_id, body) rows that the service's client refuses whole, with `reason`: not_json for
    what is no JSON object, bad_list where `entries` is no list (one may be missing from a listing,
    not from a catalogue), no_id where an entry has none, bad_entry where one has a value of another kind.
    A catalogue (`entries` "items") may also be a bare list. What is left of a refused
    listing must not heal state; see `valid_kb_files`."""
    catalogue = entries == "items"
    texts = ["name", "description"] if catalogue else ["filename"]
    parsed, is_object = _read("body")
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit("VOID"))
    whole = F.startswith(kind, F.lit("ARRAY")) if catalogue else F.lit(False)
    field = F.when(whole, parsed).otherwise(F.try_variant_get(parsed, f"$.{entries}", "variant"))
    listed = F.coalesce(F.startswith(F.schema_of_variant(field), F.lit("ARRAY")), F.lit(False))
    absent = field.isNull() & F.lit(not catalogue)
    rows = F.try_variant_get(field, "$", "array<variant>")
    reason = (
        F.when(~is_object & ~whole, "not_json")
        .when(~listed & ~absent, "bad_list")
        .when(listed, _refusal(rows, texts))
    )
    return bodies.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def valid_kb_files(bodies: DataFrame) -> DataFrame:
    """`parse_kb_files` of the listings that are whole: one of whose bodies any is refused gives no
    row at all, so that nothing is healed from it. A listing may be split over any number of bodies."""
    refused = rejected_bodies(bodies).select("kb_id").distinct()
    refused = broadcast_if_small(set_down(refused, "refused"))
    return parse_kb_files(bodies.join(refused, "kb_id", "left_anti"))


def valid_kb_catalog(bodies: DataFrame) -> DataFrame:
    """`parse_kb_catalog` of the bodies that are not refused whole."""
    reason = rejected_bodies(bodies.select("body").distinct(), "items").select("body")
    return parse_kb_catalog(bodies.join(reason, "body", "left_anti"))
