"""DataFrame operators: cleaning, checks, enrichment, event history, quick
resales, holding returns, rankings and segment medians."""

from resalekit.operators import (checks, clean, enrich, history, holding, joins, quick, ranking,
                                 segments)

__all__ = ["checks", "clean", "enrich", "history", "holding", "joins", "quick", "ranking",
           "segments"]
