"""Expressions over JSON documents held as variants, and over storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(doc: Column, name: str) -> Column:
    """A top-level field as a variant: SQL null only if the key is absent."""
    return F.try_variant_get(doc, f"$.{name}", "variant")


def kind(doc: Column, name: str) -> Column:
    """JSON type of a field: VOID, STRING, BOOLEAN, OBJECT<..>, ARRAY<..>, a number type, or null."""
    return F.schema_of_variant(field(doc, name))


def has_key(doc: Column, name: str) -> Column:
    return field(doc, name).isNotNull()


def text_of(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "string")


def is_bool(doc: Column, name: str, value: bool) -> Column:
    """Strictly equal to a boolean."""
    same = F.try_variant_get(doc, f"$.{name}", "boolean") == F.lit(value)
    return F.coalesce((kind(doc, name) == "BOOLEAN") & same, F.lit(False))


def truthy(doc: Column, name: str) -> Column:
    """JavaScript truthiness: empty arrays and objects count, "" and 0 do not."""
    k = kind(doc, name)
    return F.when(k.isNull() | (k == "VOID"), F.lit(False)) \
        .when(k == "STRING", text_of(doc, name) != "") \
        .when(k == "BOOLEAN", is_bool(doc, name, True)) \
        .when(k.rlike("^(ARRAY|OBJECT)"), F.lit(True)) \
        .otherwise(F.coalesce(F.try_variant_get(doc, f"$.{name}", "double") != 0, F.lit(False)))


def url_key(url: Column) -> Column:
    """URL as a storage key: anything but ASCII letters and digits becomes a dash."""
    return F.regexp_replace(url, "[^a-zA-Z0-9]", "-")


def day_parts(ts: Column) -> dict[str, Column]:
    return {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"),
            "day": F.date_format(ts, "dd")}


def archive_key(created: Column, link: Column) -> Column:
    return F.concat_ws("/", F.lit("backend-articles"), *day_parts(created).values(),
                       url_key(link), F.lit("backend-article.json"))


def event_key(collection: Column, user: Column, operation: Column, at: Column, message_id: Column) -> Column:
    """Log key of an event. The suffix follows from the message, so a replay keeps it."""
    suffix = F.conv(F.substring(F.md5(message_id.cast("string")), 1, 8), 16, 10).cast("long") % 1000000
    return F.concat_ws("/", collection, user, operation, *day_parts(at).values(),
                       F.concat(F.unix_millis(at).cast("string"), F.lit("-"), suffix.cast("string"),
                                F.lit(".json")))


def timestamp_of(text: Column) -> Column:
    """Timestamp of an ISO date or a mail date (``Mon, 05 Aug 2024 10:00:00 GMT``), null for any other text."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", ""), " (?:GMT|UTC?|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm[:ss] xx")))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
