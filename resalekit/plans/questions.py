"""The analysis as named pipelines over raw tables.

``Inputs`` holds the raw, clean and enriched frames of one source; each ``q_*``
function returns the DataFrame of one item. Nothing is kept between calls: a
pipeline reads its Parquet sources when it runs, so only the columns and date
ranges it needs are read and a changed source gives a changed result. Frames that several
items read can be stored: ``build_tables`` writes them as a new version of catalogue tables at
a location that the caller names (``plans.store``), and ``Inputs(..., tables=location)`` reads them from there.
``run_many`` runs a list of items and computes the frames that they share once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from types import FunctionType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resalekit.operators import checks, clean, enrich, history, holding, quick, ranking, segments
from resalekit.plans import store
from resalekit.plans.params import Params
from resalekit.plans.profile import MEASURES, Profile, numbers, watch
from resalekit.sources.bindings import BINDINGS, RawTables
from resalekit.sources.sinks import write_result

#: What ``build_tables`` stores, in the order in which one is made from another; and what else can be.
STORED = ("clean_events", "clean_entities", "enriched")
FRAMES = (*STORED, "holding", "guarded")


@dataclass
class Inputs:
    """Raw tables are those of a binding over ``sf_dir``, or ``raw_tables``. With ``tables``, frames come from the
    version that is current when the first is read, as far as it has them; ``held`` are frames to use as they are."""

    spark: SparkSession
    sf_dir: str = ""
    binding: str = "orders"
    params: Params = field(default_factory=Params)
    tables: str | None = None
    raw_tables: RawTables | None = None
    held: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def raw(self) -> RawTables:
        return self.raw_tables or BINDINGS[self.binding](self.spark, self.sf_dir)

    @cached_property
    def version(self) -> store.Version | None:
        return store.current(self.spark, self.tables) if self.tables else None

    @property
    def events(self) -> DataFrame:
        return self.raw.events

    @property
    def entities(self) -> DataFrame:
        return self.raw.entities

    def _frame(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name in self.held:
            return self.held[name]
        if self.tables and self.version is None:
            raise ValueError(f"no tables were built at {self.tables}")
        told = self.version.tables.get(name) if self.version else None
        # a frame that depends on parameters is used with the same ones only
        return store.open_table(self.spark, self.version, name) if told and told["params"] == self.frame_params(name) else build()

    def frame_params(self, name: str) -> dict:
        return {"min_hold_days": self.params.min_hold_days} if name == "guarded" else {}

    @property
    def clean_events(self) -> DataFrame:
        return self._frame("clean_events", lambda: clean.clean_events(self.events))

    @property
    def clean_entities(self) -> DataFrame:
        return self._frame("clean_entities", lambda: clean.clean_entities(self.entities))

    @property
    def enriched(self) -> DataFrame:
        return self._frame("enriched", lambda: enrich.enrich(self.clean_events, self.clean_entities, self.raw.geo))

    @property
    def holding(self) -> DataFrame:
        return self._frame("holding", lambda: holding.holding_metrics(self.enriched))

    @property
    def guarded(self) -> DataFrame:
        return self._frame("guarded", lambda: holding.guarded_metrics(self.enriched, min_days=self.params.min_hold_days))

    def to_count(self, name: str) -> DataFrame:
        """A frame with as many rows as ``name``, to be counted: of a stored table the files, whose footers tell."""
        if name not in self.held and self.tables and name in (self.version.tables if self.version else ()):
            return store.to_count(self.spark, self.version, name)
        return getattr(self, name)

    def create_view(self, name: str = "sales_enriched") -> str:
        """The enriched frame as a temporary view that SQL can read."""
        self.enriched.createOrReplaceTempView(name)
        return name


def build_tables(inputs: Inputs, location: str, names: Sequence[str] = STORED, buckets: int | None = None,
                 profiled: bool = False) -> Inputs:
    """Store frames as a new version at ``location`` (a folder that all executors share) and return
    inputs that read it. A repeated entity key or district fails before the version is used, as does an
    enriched table with another number of rows than its events: either would fan out every later window.
    Readers see the version before until then.

    ``profiled`` (for ``STORED``, at least the clean tables) takes the counts of W01, W02, W04, W10 and W13-W15 on the way, in the same scan
    of each raw table; these items then need no scan over the tables that are returned."""
    source, seen = replace(inputs, tables=None, held={}), {}
    if profiled:
        if not {"clean_events", "clean_entities"} <= set(names):
            raise ValueError("a profile comes with the write of both clean tables")
        raw = inputs.raw
        events, seen["events"] = watch(raw.events, "events")
        entities, seen["entities"] = watch(raw.entities, "entities")
        source = replace(source, raw_tables=replace(raw, events=events, entities=entities))

    def make(name: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
        def run_(held: dict[str, DataFrame]) -> DataFrame:
            own = replace(source, held=dict(held))
            if name == "enriched":
                return enrich.enrich(own.clean_events, own.clean_entities, own.raw.geo, check_keys=True)
            df = getattr(own, name)
            if profiled and name in MEASURES:
                df, seen[name] = watch(df, name)
            return df
        return run_

    def check(held: dict[str, DataFrame]) -> None:
        if {"clean_events", "enriched"} <= set(held) and held["clean_events"].count() != held["enriched"].count():
            raise ValueError("the enriched table does not have a row for each event")

    def profile(version: store.Version) -> dict | None:
        told = numbers(seen)
        if told is None:
            return None
        counts = {n: store.to_count(inputs.spark, version, n).count() for n in STORED if n in seen}
        counts |= {n: inputs.raw.to_count(n).count() for n in inputs.raw.countable}
        return told if Profile(told).agrees(counts) else None

    names = [n for n in FRAMES if n in names]
    store.build(inputs.spark, location, {n: make(n) for n in names}, params={n: inputs.frame_params(n) for n in names},
                buckets=buckets, check=check, profile=profile if profiled else None)
    return replace(inputs, tables=location, held={})


# --- preparation and checks -------------------------------------------------

def q_profile_row_counts(i: Inputs) -> DataFrame:
    return checks.row_counts({"properties_main": i.raw.to_count("entities"), "price_history": i.raw.to_count("events")})


def q_profile_date_range(i: Inputs) -> DataFrame:
    return checks.date_range(i.events)


def q_profile_events_per_year(i: Inputs) -> DataFrame:
    return checks.events_per_year(i.events)


def q_profile_missing_dates(i: Inputs) -> DataFrame:
    return checks.null_profile(i.events, "total_rows", nonnull={"nonnull_dates": "deedDate"})


def q_orphan_events(i: Inputs) -> DataFrame:
    return checks.orphans(i.events, i.entities, alias="orphan_price_rows")


def q_orphan_entities(i: Inputs) -> DataFrame:
    return checks.orphans(i.entities, i.events, alias="orphan_properties")


def q_event_cardinality(i: Inputs) -> DataFrame:
    return checks.cardinality(i.events)


def q_duplicate_event_keys(i: Inputs) -> DataFrame:
    return checks.duplicate_keys(i.events)


def q_clean_events(i: Inputs) -> DataFrame:
    return i.clean_events


def q_clean_event_count(i: Inputs) -> DataFrame:
    return checks.single_count(i.to_count("clean_events"), "rows")


def q_grain_violations(i: Inputs) -> DataFrame:
    return checks.grain_violations(i.clean_events)


def q_clean_entities(i: Inputs) -> DataFrame:
    return i.clean_entities


def q_clean_vs_raw_parity(i: Inputs) -> DataFrame:
    return checks.row_counts({"properties_main_clean": i.to_count("clean_entities"), "properties_main": i.raw.to_count("entities")})


def q_clean_null_checks(i: Inputs) -> DataFrame:
    return checks.clean_null_checks(i.clean_entities)


def q_postcode_coverage(i: Inputs) -> DataFrame:
    return checks.postcode_coverage(i.entities)


def q_enrich_sales(i: Inputs) -> DataFrame:
    return i.enriched


def q_match_report(i: Inputs) -> DataFrame:
    return enrich.match_report(i.enriched)


# --- consecutive events ------------------------------------------------------

def q_resale_change_by_type(i: Inputs) -> DataFrame:
    return history.consecutive_change(i.enriched, ["property_type"], floor=i.params.floor)


def q_resale_change_by_type_area(i: Inputs) -> DataFrame:
    return history.consecutive_change(
        i.enriched, ["property_type", "postcode_area", "postcode_area_name", "region"],
        floor=i.params.floor)


def q_time_to_next_sale(i: Inputs) -> DataFrame:
    return history.time_to_next(i.enriched)


# --- quick resales -----------------------------------------------------------

def _quick_kw(i: Inputs) -> dict:
    return {"max_years": i.params.quick_years, "min_days": i.params.quick_min_days}


def q_quick_resale_flags(i: Inputs) -> DataFrame:
    return quick.quick_flags(i.enriched, **_quick_kw(i))


def q_quick_resale_shares(i: Inputs) -> DataFrame:
    return quick.quick_shares(i.enriched, **_quick_kw(i))


def q_quick_resale_gains(i: Inputs) -> DataFrame:
    return quick.quick_gains(i.enriched, floor=i.params.floor, **_quick_kw(i))


def q_quick_resale_summary(i: Inputs) -> DataFrame:
    return quick.quick_resale_summary(i.enriched, floor=i.params.floor, **_quick_kw(i))


# --- segments ----------------------------------------------------------------

def q_period_growth_wide(i: Inputs) -> DataFrame:
    return segments.period_growth(i.enriched, i.params.growth_years, min_count=i.params.min_count)


def q_period_growth_long(i: Inputs) -> DataFrame:
    return segments.growth_long(q_period_growth_wide(i), i.params.growth_years)


def q_premium_new_vs_old(i: Inputs) -> DataFrame:
    return segments.segment_premium(i.enriched, area_name=i.params.premium_area)


def q_premium_new_vs_old_all(i: Inputs) -> DataFrame:
    """W26 without the area filter."""
    return segments.segment_premium(i.enriched)


def q_median_by_tenure(i: Inputs) -> DataFrame:
    return segments.segment_median(i.enriched)


def q_busiest_areas(i: Inputs) -> DataFrame:
    return segments.busiest_areas(i.enriched, i.params.shocks, i.params.n_areas)


def q_shock_year_medians(i: Inputs) -> DataFrame:
    return segments.shock_windows(i.enriched, i.params.shocks, i.params.n_areas)


# --- holding returns -----------------------------------------------------------

def q_holding_metrics(i: Inputs) -> DataFrame:
    return i.holding


def q_holding_review_flag(i: Inputs) -> DataFrame:
    p = i.params
    return holding.review_flag(i.holding, floor=p.floor,
                               short_years=p.short_years, cap=p.cap)


def q_winners_losers_dense(i: Inputs) -> DataFrame:
    p = i.params
    flagged = q_holding_review_flag(i)
    rankable = flagged.where((F.col("first_price") >= F.lit(p.floor)) & F.col("pct_change").isNotNull())
    out = ranking.two_sided_dense(rankable, "pct_change", p.top_n)
    return out.orderBy("bucket", "rank_in_bucket", F.col("pct_change").desc(), "property_id")


def q_holding_metrics_guarded(i: Inputs) -> DataFrame:
    return i.guarded


def q_winners_losers_annualized(i: Inputs) -> DataFrame:
    p = i.params
    m = q_holding_metrics_guarded(i)
    kept = m.where((F.col("first_recorded_price") >= F.lit(p.floor))
                   & ((F.col("annualized_return") <= F.lit(p.cap))
                      | (F.col("days_held") < F.lit(p.min_hold_days))))
    return ranking.two_sided_limit(kept, "annualized_return", p.top_n)


def q_filter_retention(i: Inputs) -> DataFrame:
    p = i.params
    return holding.retention(q_holding_metrics_guarded(i), floor=p.floor,
                             min_days=p.min_hold_days, cap=p.cap)


# --- sink ------------------------------------------------------------------------

def q_export_long_result(i: Inputs) -> DataFrame:
    """The long growth table, written below the shared folder and read back."""
    from resalekit.session import shared_dir
    path = write_result(q_period_growth_long(i), shared_dir(i.spark, "exports", "period_growth_long"))
    return i.spark.read.parquet(path)


PIPELINES = {
    "profile_row_counts": q_profile_row_counts,
    "profile_date_range": q_profile_date_range,
    "profile_events_per_year": q_profile_events_per_year,
    "profile_missing_dates": q_profile_missing_dates,
    "orphan_events": q_orphan_events,
    "orphan_entities": q_orphan_entities,
    "event_cardinality": q_event_cardinality,
    "duplicate_event_keys": q_duplicate_event_keys,
    "clean_events": q_clean_events,
    "clean_event_count": q_clean_event_count,
    "grain_violations": q_grain_violations,
    "clean_entities": q_clean_entities,
    "clean_vs_raw_parity": q_clean_vs_raw_parity,
    "clean_null_checks": q_clean_null_checks,
    "postcode_coverage": q_postcode_coverage,
    "enrich_sales": q_enrich_sales,
    "match_report": q_match_report,
    "resale_change_by_type": q_resale_change_by_type,
    "resale_change_by_type_area": q_resale_change_by_type_area,
    "time_to_next_sale": q_time_to_next_sale,
    "quick_resale_flags": q_quick_resale_flags,
    "quick_resale_shares": q_quick_resale_shares,
    "quick_resale_gains": q_quick_resale_gains,
    "quick_resale_summary": q_quick_resale_summary,
    "period_growth_wide": q_period_growth_wide,
    "period_growth_long": q_period_growth_long,
    "premium_new_vs_old": q_premium_new_vs_old,
    "premium_new_vs_old_all": q_premium_new_vs_old_all,
    "median_by_tenure": q_median_by_tenure,
    "holding_metrics": q_holding_metrics,
    "holding_review_flag": q_holding_review_flag,
    "winners_losers_dense": q_winners_losers_dense,
    "holding_metrics_guarded": q_holding_metrics_guarded,
    "winners_losers_annualized": q_winners_losers_annualized,
    "filter_retention": q_filter_retention,
    "busiest_areas": q_busiest_areas,
    "shock_year_medians": q_shock_year_medians,
    "export_long_result": q_export_long_result,
}


def run(name: str, spark: SparkSession, sf_dir: str = "", binding: str = "orders",
        params: Params | None = None, tables: str | None = None, raw_tables: RawTables | None = None) -> DataFrame:
    """One item over a binding of the driver's tables, or over ``raw_tables`` (see
    ``bind_raw``); with ``tables``, off the stored clean and enriched tables."""
    return answer(name, Inputs(spark, sf_dir, binding, params or Params(), tables, raw_tables))


def answer(name: str, inputs: Inputs) -> DataFrame:
    """One item: from the profile of the stored tables, if they have one that tells it, else computed."""
    told = inputs.version.profile if inputs.tables and inputs.version else None
    df = Profile(told).frame(inputs.spark, name) if told else None
    return PIPELINES[name](inputs) if df is None else df


def frames_of(name: str) -> set[str]:
    """The frames that an item reads: those its function names, and the functions that it calls."""
    seen: set[FunctionType] = set()

    def walk(function: FunctionType) -> set[str]:
        if function in seen:
            return set()
        seen.add(function)
        names = function.__code__.co_names
        named = {*names, *(c for c in function.__code__.co_consts if isinstance(c, str))}  # attributes, or given to ``to_count``
        called = [f for n in names if isinstance(f := function.__globals__.get(n), FunctionType) and n.startswith("q_")]
        return set(FRAMES).intersection(named).union(*map(walk, called))

    return walk(PIPELINES[name])


def shared_frames(names: Sequence[str]) -> list[str]:
    """The frames that more than one of these items reads, or makes another shared frame from, in the order of building."""
    made_from = {"enriched": ("clean_events", "clean_entities"), "holding": ("enriched",), "guarded": ("enriched",)}
    uses = Counter(f for n in names for f in frames_of(n))
    shared: list[str] = []
    for frame in reversed(FRAMES):  # the last ones first: they read those before them
        if uses[frame] > 1:
            shared.insert(0, frame)
        if uses[frame]:
            uses.update(made_from.get(frame, ()))
    return shared


def run_many(names: Sequence[str], spark: SparkSession, sf_dir: str = "", location: str = "", binding: str = "orders",
             params: Params | None = None, raw_tables: RawTables | None = None, buckets: int | None = None) -> dict[str, DataFrame]:
    """Several items of one source. The frames that they share are computed once and stored as
    a new version at ``location``; all items read that version."""
    inputs = Inputs(spark, sf_dir, binding, params or Params(), None, raw_tables)
    if shared := shared_frames(names):
        inputs = build_tables(inputs, location, shared, buckets, profiled={"clean_events", "clean_entities"} <= set(shared))
    return {name: answer(name, inputs) for name in names}
