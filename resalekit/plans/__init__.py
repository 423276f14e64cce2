"""Pipelines (one per analysis item) and their ANSI SQL oracle texts."""

from resalekit.plans.params import Params
from resalekit.plans.questions import PIPELINES, Inputs, build_tables, run, run_many

__all__ = ["PIPELINES", "Inputs", "Params", "build_tables", "run", "run_many"]
