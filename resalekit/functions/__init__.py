"""Column expressions (numeric, text) and the distributed exact median."""

from resalekit.functions.median import group_median, group_medians
from resalekit.functions.numeric import (days_between, parse_date, parse_money, pct_change,
                                         round_half_up, safe_div, years_between)
from resalekit.functions.text import (extract_postcode, label_or_unknown, normalise_key,
                                      outward_code)

__all__ = ["group_median", "group_medians", "days_between", "parse_date", "parse_money",
           "pct_change", "round_half_up", "safe_div", "years_between", "extract_postcode",
           "label_or_unknown", "normalise_key", "outward_code"]
