"""Findings from image metadata records (JSON text as metadata readers print it)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import redact
from ..model import SCANNER_IMAGE


_RECORD = "__record"


def _whole_json(text: Column) -> Column:
    """``{"all": …}`` of a text that is JSON from its first to its last character, else NULL.

    The parser stops after the first value.  Put into brackets and into braces, a text with anything behind
    its first value fails in at least one of the two.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(listed.isNotNull(), F.try_parse_json(F.concat(F.lit('{"all":'), text, F.lit("}"))))


def _field(name: str) -> Column:
    """A field of the first record as text; NULL if it is missing or null."""
    return F.try_variant_get(_RECORD, f"$.all[0].{name}", "string")


def _filled(*names: str) -> Column:
    """The first field that is there, or NULL if it counts as absent: empty text, the number 0, false.

    Texts that only look like a number or false are values.
    """
    fields = [F.try_variant_get(_RECORD, f"$.all[0].{name}", "variant") for name in names]
    value = F.coalesce(*[F.when(_field(name).isNotNull(), field) for name, field in zip(names, fields)])
    text = F.try_variant_get(value, "$", "string")
    absent = F.when(F.schema_of_variant(value) == "STRING", text == "").otherwise(
        (text == "false") | (F.try_variant_get(value, "$", "double") == 0)
    )
    return F.when(~F.coalesce(absent, F.lit(False)), text)


def parse_metadata(df: DataFrame, keys: Sequence[str], record: str = "meta_json") -> DataFrame:
    """The first record's fields; an unreadable or empty record gives a row without values.

    A record is read as a whole or not at all: whatever follows the JSON makes it unreadable.
    """
    lat, lng = _field("GPSLatitude"), _field("GPSLongitude")
    has_gps = lat.isNotNull() & lng.isNotNull()
    return df.withColumn(_RECORD, _whole_json(F.col(record))).select(
        *keys,
        has_gps.alias("has_gps"),
        F.when(has_gps, lat).alias("gps_lat"),
        F.when(has_gps, lng).alias("gps_lng"),
        _filled("SerialNumber", "InternalSerialNumber").alias("device_serial"),
        _filled("OwnerName").alias("owner_name"),
        _filled("Model").alias("camera_model"),
        _filled("Software").alias("software"),
        _filled("DateTimeOriginal", "CreateDate").alias("taken_at"),
    )


def _gps_metadata(store_exact: bool) -> Column:
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    noted = F.array(entry("gps", F.lit(V.EVIDENCE["gps-note"])))
    place = noted
    if store_exact:
        exact = F.array(entry("gpsLat", F.col("gps_lat")), entry("gpsLng", F.col("gps_lng")))
        # an empty coordinate text counts as absent
        place = F.when((F.col("gps_lat") != "") & (F.col("gps_lng") != ""), exact).otherwise(noted)
    camera = F.array_compact(
        F.array(F.when(F.col("camera_model").isNotNull(), entry("cameraModel", F.col("camera_model"))))
    )
    return F.map_from_entries(F.concat(place, camera))


def image_findings(parsed: DataFrame, keys: Sequence[str], store_exact_gps: bool = False) -> DataFrame:
    """Up to five findings per parsed record."""
    gps = (
        F.concat(F.lit("GPS: "), "gps_lat", F.lit(", "), "gps_lng")
        if store_exact_gps
        else F.lit(V.EVIDENCE["gps-redacted"])
    )
    no_metadata = F.lit(None).cast("map<string,string>")
    evidence = (
        (F.col("has_gps"), gps, _gps_metadata(store_exact_gps)),
        (F.col("device_serial").isNotNull(),
         F.concat(F.lit("Device serial: "), redact.serial(F.col("device_serial"))), no_metadata),
        (F.col("owner_name").isNotNull(), F.concat(F.lit("Owner name: "), "owner_name"), no_metadata),
        (F.col("camera_model").isNotNull(), F.concat(F.lit("Camera model: "), "camera_model"), no_metadata),
        (F.col("software").isNotNull(), F.concat(F.lit("Software: "), "software"), no_metadata),
    )
    hits = [
        F.when(
            present,
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(severity).alias("severity"),
                text.alias("redacted_evidence"),
                metadata.alias("metadata"),
                F.lit(SCANNER_IMAGE).alias("scanner_ord"),
                F.lit(i).alias("rule_ord"),
            ),
        )
        for i, ((rule, severity), (present, text, metadata)) in enumerate(zip(V.EXIF_RULES, evidence))
    ]
    return (
        parsed.select(*keys, F.explode_outer(F.array_compact(F.array(*hits))).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(*keys, "hit.*")
    )
