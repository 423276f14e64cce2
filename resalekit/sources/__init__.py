"""Sources (raw readers, driver-table bindings) and the result sink."""

from resalekit.sources.bindings import BINDINGS, RawTables, bind_lineitem, bind_orders
from resalekit.sources.readers import read_geo_map, read_raw_entities, read_raw_events
from resalekit.sources.sinks import write_result

__all__ = ["BINDINGS", "RawTables", "bind_lineitem", "bind_orders", "read_geo_map",
           "read_raw_entities", "read_raw_events", "write_result"]
