"""Parameters of the analysis; the defaults are what the driver data calls for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    floor: float = 10000
    growth_years: tuple[int, int] = (1996, 2000)
    min_count: int = 10
    premium_area: str | None = "NATION_5"
    shocks: tuple[int, int] = (1996, 1999)
    n_areas: int = 6
    top_n: int = 10
    quick_years: tuple[int, int] = (2, 5)
    quick_min_days: int = 7
    short_years: float = 1.0
    min_hold_days: int = 90
    cap: float = 25.0
