"""resalekit: entity event-history analytics as Spark DataFrame operators.

Clean raw event and entity tables, enrich events with entity attributes and
a geography map, then answer repeat-event questions (change between
consecutive events, time to next event, quick resales, first-to-last holding
returns, two-sided rankings, segment medians, shock windows, filter funnels).

Every operator takes and returns a ``pyspark.sql.DataFrame``; no UDFs, no
driver-side loops over data.
"""

from resalekit.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
