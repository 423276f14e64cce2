"""Stored frames of the analysis (S4, S5, S6): versions of catalogue tables at a location.

A location that all executors share holds ``versions/<id>/<table>`` and
``pointers/<number>``, small files of which the last one names the version that readers
use. A build writes a new version, checks it, and then adds a pointer, so a failed build
leaves the readers where they were, and a reader that has begun goes on with its version.
``expire`` removes versions that no recent pointer names.

Tables with an entity key are bucketed by it and sorted by key and date, one file per
bucket, and registered in the catalogue under a name that is theirs alone. So a window over an entity's events, a
join by entity and a first or last event need no shuffle, and the window no sort."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from resalekit.sources.readers import footer_rows

KEY = "property_id"
#: Order within an entity, for the tables that are bucketed.
LAYOUT = {"clean_events": ("sale_date",), "clean_entities": (), "enriched": ("sale_date",)}
#: With one sorted file per bucket, Spark may take the files' order for granted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class Version:
    location: str
    number: int
    folder: str
    tables: Mapping[str, dict]
    profile: Mapping[str, dict] | None = None


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and times (ms) of what is in a folder; none if there is no such folder."""
    path, fs = _path(spark, folder)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _read(spark: SparkSession, name: str) -> str:
    path, fs = _path(spark, name)
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointers(spark: SparkSession, location: str) -> list[tuple[int, int]]:
    return [(int(n), at) for n, at in _children(spark, f"{location}/pointers") if n.isdigit()]


def _version(spark: SparkSession, location: str, number: int) -> Version:
    told = json.loads(_read(spark, f"{location}/pointers/{number:08d}"))
    return Version(location, number, f"{location}/versions/{told['version']}", told["tables"], told.get("profile"))


def current(spark: SparkSession, location: str) -> Version | None:
    """The version that the last pointer names; None where nothing was ever built."""
    location = location.rstrip("/")
    found = _pointers(spark, location)
    return _version(spark, location, found[-1][0]) if found else None


def _table_name(version: Version, name: str) -> str:
    return f"resale_{hashlib.sha256(version.folder.encode()).hexdigest()[:16]}_{name}"


def open_table(spark: SparkSession, version: Version, name: str) -> DataFrame:
    """A table of a version, registered in the catalogue if this session has not met it yet."""
    told, table = version.tables[name], _table_name(version, name)
    spark.conf.set(ORDERED, "true")
    if not spark.catalog.tableExists(table):
        buckets = told["buckets"]
        order = ", ".join(f"`{c}`" for c in (KEY, *LAYOUT.get(name, ())))
        clustered = f"CLUSTERED BY (`{KEY}`) SORTED BY ({order}) INTO {buckets} BUCKETS" if buckets else ""
        place = f"{version.folder}/{name}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {table} ({told['columns']}) USING parquet {clustered} LOCATION '{place}'")
    return spark.table(table)


def to_count(spark: SparkSession, version: Version, name: str) -> DataFrame:
    """A table of a version, to be counted: the footers of its files tell."""
    return footer_rows(spark, f"{version.folder}/{name}", version.tables[name]["columns"])


def build(spark: SparkSession, location: str, frames: Mapping[str, Callable[[dict[str, DataFrame]], DataFrame]], *,
          params: Mapping[str, dict] | None = None, buckets: int | None = None,
          check: Callable[[dict[str, DataFrame]], None] | None = None,
          profile: Callable[[Version], dict | None] | None = None) -> Version:
    """Write the frames as a new version and point to it. Each is a function of the tables
    written before it. ``check`` raises for a version that must not be used; what is written then stays unnamed and
    goes with ``expire``. ``profile`` gives what is kept of the tables with the pointer. ``buckets`` defaults to the number of shuffle partitions; choose it so that
    one bucket of events fits a task."""
    location = location.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ident = uuid.uuid4().hex[:16]
    tables: dict[str, dict] = {}
    version = Version(location, 0, f"{location}/versions/{ident}", tables)
    held: dict[str, DataFrame] = {}
    for name, make in frames.items():
        df, path = make(held), f"{version.folder}/{name}"
        own = buckets if name in LAYOUT else 0
        if own:
            rows = df.repartition(own, KEY).write.format("parquet").option("path", path)
            rows.bucketBy(own, KEY).sortBy(KEY, *LAYOUT[name]).saveAsTable(_table_name(version, name))
        else:
            df.write.parquet(path)
        tables[name] = {"buckets": own, "columns": df._jdf.schema().toDDL(), "params": dict((params or {}).get(name, {}))}
        held[name] = open_table(spark, version, name)
    if check:
        check(held)
    return _point(spark, replace(version, profile=profile(version) if profile else None), ident)


def _point(spark: SparkSession, version: Version, ident: str) -> Version:
    """Add the next pointer: written aside and renamed, so it is there whole or not at all.
    Of two builders that end at once one fails and its version stays unnamed."""
    number = max([n for n, _ in _pointers(spark, version.location)], default=0) + 1
    name = f"{version.location}/pointers/{number:08d}"
    aside, fs = _path(spark, f"{version.location}/pointers/_{ident}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps({"version": ident, "tables": dict(version.tables), "profile": version.profile}).encode()))
    finally:
        stream.close()
    target, _ = _path(spark, name)
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"another build has written {name}")
    return replace(version, number=number)


def expire(spark: SparkSession, location: str, keep: int = 2, older_than: float = 7 * 86400) -> list[str]:
    """Remove pointers but the last ``keep`` that are older than ``older_than`` seconds, and the versions
    that no pointer names and that are as old (a build that failed, too). Returns the versions' folders."""
    location = location.rstrip("/")
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    old = lambda at: now - at >= older_than * 1000
    found = _pointers(spark, location)
    named = set()
    for place, (number, at) in enumerate(found):
        if place < len(found) - max(1, keep) and old(at):
            path, fs = _path(spark, f"{location}/pointers/{number:08d}")
            fs.delete(path, False)
        else:
            named.add(_version(spark, location, number).folder)
    gone = []
    for ident, at in _children(spark, f"{location}/versions"):
        folder = f"{location}/versions/{ident}"
        if folder not in named and old(at):
            version = Version(location, 0, folder, {})
            for name, _ in _children(spark, folder):
                spark.sql(f"DROP TABLE IF EXISTS {_table_name(version, name)}")
            path, fs = _path(spark, folder)
            fs.delete(path, True)
            gone.append(folder)
    return gone
