"""Display values, time texts, URLs and ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_millis(ts: Column) -> Column:
    """UTC time with milliseconds, e.g. 2024-01-30T23:59:25.261Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def default_value(widget_type: Column) -> Column:
    """Initial value of a new widget."""
    return F.when(widget_type == "toggle", "false").when(widget_type == "slider", "0").otherwise("")


def leading_integer(value: Column) -> Column:
    """Integer at the start of a text, decimal or 0x-hexadecimal; 0 when there is none."""
    parts = r"^\s*([+-]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+))"
    sign = F.regexp_extract(value, parts, 1)
    hexadecimal = F.regexp_extract(value, parts, 2)
    digits = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(
        F.regexp_extract(value, parts, 3))
    return F.coalesce(F.nullif(F.concat(sign, digits), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def is_on(value: Column) -> Column:
    """Only the exact text ``true`` switches a toggle on."""
    return value.eqNullSafe(F.lit("true"))


def toggle_label(value: Column) -> Column:
    # Labels shown for on and off.
    return F.when(is_on(value), "NYALA").otherwise("MATI")


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else a dash."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:1]], *values[1:], F.lit("-"))


def page_url(slug: Column) -> Column:
    return F.concat(F.lit("/"), slug)


def page_slug(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def valid_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike(r"\A[a-zA-Z0-9_-]+\z"), F.lit(False))


def query_field(url: Column, name: str) -> Column:
    """Decoded query-string field of a URL or request path; NULL when missing or empty."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    text = F.regexp_extract(query, f"(?:^|&){name}=([^&]*)", 1)
    return F.nullif(F.coalesce(F.try_url_decode(text), text), F.lit(""))


def as_id(value: Column) -> Column:
    """Numeric id of a text or number, NULL when it is not one."""
    return F.trim(value.cast("string")).try_cast("bigint")
