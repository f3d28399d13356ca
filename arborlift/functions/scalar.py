"""Small column expressions on text, time and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Remote states and the states they map to.
EXPORT_STATES = {
    "PENDING": "pending_export", "RUNNING": "exporting", "SUCCEEDED": "exported",
    "FAILED": "failed", "CANCELLED": "cancelled", "CANCELLING": "exporting",
}
RUN_STATES = {
    "FINISHED": "succeeded", "FAILED": "failed", "CANCELLED": "cancelled",
    "RUNNING": "running", "READY": "running",
}
SERIES = ((r"^fc_\d{4}$", "fc_2020"), (r"^pop_\d{4}$", "pop_2020"))


def mapped_state(state: Column, states: dict[str, str], default: str | None) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    found = lookup[F.upper(state)]
    return found if default is None else F.coalesce(found, F.lit(default))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 time, NULL when it cannot be read."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def shown_date(date: Column, missing: str) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(missing))


def period(first: Column, last: Column) -> Column:
    return F.when(first.isNotNull(), F.concat(first.cast("string"), F.lit("-"),
                                              last.cast("string"))).otherwise("-")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def bucket_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^[a-z0-9]+://([^/]+)", 1)


def key_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^[a-z0-9]+://[^/]+/(.*)$", 1)


def layer_of_object(key: Column) -> Column:
    """File name without folder and ``.tif``."""
    return F.regexp_replace(F.element_at(F.split(key, "/"), -1), "[.]tif$", "")


def zeroed(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def skew_flag(mean: Column, median: Column) -> Column:
    """Label by mathematics: a mean far above the median is a right tail."""
    return (
        F.when(mean > median * 2, "right-skewed").when(mean < median * 0.5, "left-skewed")
        .otherwise("balanced")
    )


def series_representative(name: Column) -> Column:
    """Layer that stands for a yearly series in profiles, NULL if it is its own."""
    out = F.lit(None).cast("string")
    for pattern, keeper in SERIES:
        out = F.when(name.rlike(pattern) & (name != keeper), keeper).otherwise(out)
    return out


def formula_terms(formula: Column) -> Column:
    """Right-hand terms of a formula text."""
    rhs = F.split(F.regexp_replace(formula, "^.*~", ""), "[+]")
    return F.transform(rhs, lambda t: F.trim(t))


def diagnostic_key(site_id: Column, id_numeric: Column) -> Column:
    return F.coalesce(F.nullif(site_id, F.lit("")), id_numeric.cast("string"))


def normalised_list(text: Column, record: str) -> Column:
    """JSON list, object of objects or single object, as an array of records.

    A single record is told from an object of records by its first value.
    """
    shape = F.substring(F.trim(text), 1, 1)
    as_list = F.from_json(text, f"array<{record}>")
    nested = text.rlike(r'^\s*\{\s*"[^"]*"\s*:\s*\{')
    as_map = F.map_values(F.from_json(text, f"map<string,{record}>"))
    single = F.array(F.from_json(text, record))
    empty = F.from_json(F.lit("[]"), f"array<{record}>")
    return F.coalesce(
        F.when(shape == "[", as_list).when(nested, as_map).when(shape == "{", single), empty
    )


def site_label(site_id: Column, own: Column, total: Column) -> Column:
    """Own name unless it repeats the id, then the totals' name, then the id."""
    return F.coalesce(F.nullif(own, site_id), F.nullif(total, F.lit("")), site_id)
