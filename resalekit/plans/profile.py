"""The checks that come with the write of the clean tables.

``watch`` puts ``DataFrame.observe`` on raw and clean frames, so that counts, the date range, nulls
and postcode coverage are computed by the jobs that clean and write them: each raw table is scanned
once. ``Profile`` answers the items from these few numbers, without a scan.

Spark may count the rows of a task again that runs a second time after a lost executor. So ``Profile.agrees`` holds
every total against a count of its own, which Parquet files answer from their footers; a profile that does not
agree is not kept, and the items scan as before."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from resalekit.functions.numeric import parse_date
from resalekit.functions.text import extract_postcode

ROWS = "rows"
#: What is observed of each frame, by name of the number.
MEASURES: Mapping[str, Callable[[], dict[str, Column]]] = {
    "events": lambda: {ROWS: F.count(F.lit(1)), "dated": F.count("deedDate"),
                       "first": F.min(parse_date("deedDate")), "last": F.max(parse_date("deedDate"))},
    "entities": lambda: {ROWS: F.count(F.lit(1)), "with_postcode": F.count(extract_postcode("address"))},
    "clean_events": lambda: {ROWS: F.count(F.lit(1))},
    "clean_entities": lambda: {ROWS: F.count(F.lit(1)), "no_postcode": F.count_if(F.col("postcode").isNull()),
                               "no_price": F.count_if(F.col("latest_sale_price").isNull()),
                               "no_date": F.count_if(F.col("latest_sale_date").isNull())},
}


def watch(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and what the first job over it tells of it."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in MEASURES[name]().items()]), seen


def numbers(seen: Mapping[str, Observation]) -> dict[str, dict] | None:
    """The observed numbers as JSON values; None if Spark observed nothing of a frame, as of one that it
    knows to be empty before any job. Waits for the jobs: call it when they are over."""
    try:
        return {name: {k: v.isoformat() if isinstance(v, dt.date) else v for k, v in o.get.items()} for name, o in seen.items()}
    except Py4JJavaError:  # the observed row is empty
        return None


@dataclass(frozen=True)
class Profile:
    told: Mapping[str, Mapping]

    def agrees(self, counts: Mapping[str, int]) -> bool:
        """Whether every total is as counted; no less is known of a frame that is not counted."""
        return all(self.told[name][ROWS] == n for name, n in counts.items())

    def frame(self, spark: SparkSession, item: str) -> DataFrame | None:
        """The result of an item; None if it is not among those that a profile answers."""
        events, entities, clean, clean_entities = (self.told[n] for n in MEASURES)
        day = lambda v: v and dt.date.fromisoformat(v)
        rows = {
            "profile_row_counts": ("table_name string, rows long", [("properties_main", entities[ROWS]), ("price_history", events[ROWS])]),
            "profile_date_range": ("earliest_deedDate date, latest_deedDate date", [(day(events["first"]), day(events["last"]))]),
            "profile_missing_dates": ("total_rows long, nonnull_dates long", [(events[ROWS], events["dated"])]),
            "clean_event_count": ("rows long", [(clean[ROWS],)]),
            "clean_vs_raw_parity": ("table_name string, rows long", [("properties_main_clean", clean_entities[ROWS]),
                                                                     ("properties_main", entities[ROWS])]),
            "clean_null_checks": ("null_postcode long, null_latest_sale_price long, missing_latest_sale_date long",
                                  [tuple(clean_entities[k] for k in ("no_postcode", "no_price", "no_date"))]),
            "postcode_coverage": ("total_rows long, postcode_found long", [(entities[ROWS], entities["with_postcode"])]),
        }
        return spark.createDataFrame(rows[item][1], rows[item][0]) if item in rows else None
