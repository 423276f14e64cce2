"""Text expressions: postcode extraction, district, labels, join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value (must equal the reference's pattern for identical results):
# UK postcode, matched on the upper-cased address, first match wins.
POSTCODE_PATTERN = r"([A-Z]{1,2}[0-9][0-9A-Z]?\s?[0-9][A-Z]{2})"

UNKNOWN = "Unknown"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def extract_postcode(address) -> Column:
    """First postcode-shaped token of upper(address), NULL when none
    (regexp_extract returns '' on no match, so it is mapped to NULL)."""
    return F.nullif(F.regexp_extract(F.upper(_c(address)), POSTCODE_PATTERN, 1), F.lit(""))


def outward_code(postcode, compact: bool = False) -> Column:
    """Part before the first space ('SW7 1RH' -> 'SW7'); a postcode written
    without the space comes back whole and will not match a district map, unless
    ``compact`` is set: then its inward code, the last three characters, is cut off ('SW71RH' -> 'SW7')."""
    c = _c(postcode)
    outward = F.split_part(c, F.lit(" "), F.lit(1))
    return F.when(c.rlike(r"\s"), outward).otherwise(F.substring(c, F.lit(1), F.length(c) - 3)) if compact else outward


def normalise_key(col) -> Column:
    """Join key normalisation: UPPER(TRIM(x)) (spaces only)."""
    return F.upper(F.trim(_c(col)))


def label_or_unknown(col, blank_is_unknown: bool = False) -> Column:
    """COALESCE(x, 'Unknown'); with ``blank_is_unknown`` also trims and maps
    '' to 'Unknown' (COALESCE(NULLIF(TRIM(x), ''), 'Unknown'))."""
    c = _c(col)
    if blank_is_unknown:
        c = F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(c, F.lit(UNKNOWN))


def map_labels(col, mapping: dict[str, str], default: str = UNKNOWN) -> Column:
    """CASE x WHEN k THEN v ... ELSE default END."""
    c = _c(col)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
