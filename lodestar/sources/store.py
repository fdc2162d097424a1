"""Versioned tables on Parquet with a change log.

`_changes/<version>.json` is the log: one file for each commit, numbered without gaps, made whole and under a free name or
not at all. It holds the table's state after the commit (schema, constraints, indexes, partitions, data files, deletion
files) and what the commit added. A file that no commit names does not exist for readers, so a crash between writing
data and committing leaves the table as it was. `_checkpoint/<version>.json` holds all tables' states, so that the log
before it can go once no replica needs it. A checkpoint is made every CHECKPOINT_EVERY commits; what the one before it covers
goes then by itself, so a writer that is less far behind still meets the commit that was first, and one that is further
behind meets the checkpoint. Both kinds of files begin with a checksum of the rest; a damaged one is an error, not a shorter log.

Data files are never changed. A deletion file lists (file, row) of dead rows; a read takes them out of the data files that
have any by an anti-join, and leaves the other files' plan as it is. New rows are written before they are checked, so their
source is evaluated once; what fails its checks is deleted and never named.

`_replicas/<name>/<version>` says how far each replica has come: files and log entries that one still needs stay.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import zlib
from dataclasses import asdict, dataclass, field, replace
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import types
from lodestar.functions.expressions import timestamp_literal
from lodestar.plans.errors import ConstraintError, EngineError
from lodestar.sources import partitions
from lodestar.sources.files import Files

#: A table is vacuumed when more than this share of its rows is dead, and compacted when it has this many commits' files.
DEAD_SHARE, MANY_FILES, ROWS_PER_FILE, CHECKPOINT_EVERY = 0.2, 32, 5_000_000, 50
FILE, ROW = "__file", "__row"


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    not_null: bool = False
    length: int | None = None
    default: Any = None


@dataclass(frozen=True)
class ConstraintInfo:
    name: str
    primary: bool
    columns: tuple[str, ...]


@dataclass(frozen=True)
class IndexInfo:
    name: str
    columns: tuple[str, ...]
    unique: bool


@dataclass(frozen=True)
class FileInfo:
    """A data file or a folder of deletion files: name below the root, partition; of a deletion the data files that it has rows of.

    ranges: of a data file (column, smallest, largest value) of the whole numbers, dates and times among keys and indexes.
    """

    name: str
    partition: str | None = None
    of: tuple[str, ...] = ()
    ranges: tuple[tuple[str, Any, Any], ...] = ()

    def may_hold(self, conditions: list[tuple[str, str, Any]]) -> bool:
        """Whether the ranges leave room for a row with all conditions (column, operator, value)."""
        return all(_overlaps(low, high, op, value) for c, low, high in self.ranges for column, op, value in conditions if c == column)


def _overlaps(low: Any, high: Any, op: str, value: Any) -> bool:
    if low is None or value is None:  # nulls satisfy no comparison
        return False
    if type(value) is not type(low):  # other types compare by Spark's rules
        return True
    return {"=": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}.get(op, True)


@dataclass(frozen=True)
class State:
    """A table at a version."""

    name: str
    columns: tuple[ColumnInfo, ...]
    constraints: tuple[ConstraintInfo, ...] = ()
    indexes: tuple[IndexInfo, ...] = ()
    partition_by: str | None = None
    partitions: tuple[partitions.Partition, ...] = ()
    files: tuple[FileInfo, ...] = ()
    deletions: tuple[FileInfo, ...] = ()
    rows: int = 0  # in files, dead ones too
    dead: int = 0
    epoch: str = field(default="", compare=False)  # tells a table made anew from its predecessor

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, types.SPARK[c.type], True) for c in self.columns])

    def column(self, name: str) -> ColumnInfo:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(f"unknown column {name}")

    def keys(self) -> list[tuple[str, tuple[str, ...]]]:
        """Name and columns of everything that must be unique."""
        return [*((c.name, c.columns) for c in self.constraints), *((i.name, i.columns) for i in self.indexes if i.unique)]


def _plain(value: Any) -> Any:
    return {"$date": value.isoformat()} if type(value) is dt.date else {"$timestamp": value.isoformat()} if isinstance(value, dt.datetime) else value


def _value(value: Any) -> Any:
    if isinstance(value, dict) and "$date" in value:
        return dt.date.fromisoformat(value["$date"])
    if isinstance(value, dict) and "$timestamp" in value:
        return dt.datetime.fromisoformat(value["$timestamp"])
    return value


def literal(value: Any) -> Column:
    return timestamp_literal(value.isoformat(sep=" ")) if isinstance(value, dt.datetime) else F.lit(value)


def dump(state: State | None) -> dict | None:
    if state is None:
        return None
    d = asdict(state)
    for c in d["columns"]:
        c["default"] = _plain(c["default"])
    d["partitions"] = [[n, _plain(b), x] for n, b, x in d["partitions"]]
    for f in d["files"]:
        f["ranges"] = [[c, _plain(low), _plain(high)] for c, low, high in f["ranges"]]
    return d


def load(d: dict | None) -> State | None:
    if d is None:
        return None
    return State(
        d["name"],
        tuple(ColumnInfo(**{**c, "default": _value(c["default"])}) for c in d["columns"]),
        tuple(ConstraintInfo(c["name"], c["primary"], tuple(c["columns"])) for c in d["constraints"]),
        tuple(IndexInfo(i["name"], tuple(i["columns"]), i["unique"]) for i in d["indexes"]),
        d["partition_by"],
        tuple((n, _value(b), x) for n, b, x in d["partitions"]),
        tuple(FileInfo(f["name"], f["partition"], (), tuple((c, _value(low), _value(high)) for c, low, high in f["ranges"])) for f in d["files"]),
        tuple(FileInfo(f["name"], f["partition"], tuple(f["of"])) for f in d["deletions"]),
        d["rows"],
        d["dead"],
        d["epoch"],
    )


def seal(record: dict) -> str:
    """A record of the log, one line: the checksum of the JSON text, then the text."""
    body = json.dumps(record)
    return f"{zlib.crc32(body.encode()):08x} {body}"


def unseal(text: str, name: str = "a record of the log") -> dict:
    mark, _, body = text.partition(" ")
    if mark != f"{zlib.crc32(body.encode()):08x}":
        raise EngineError(f"{name} is damaged")
    return json.loads(body)


class Conflict(EngineError):
    """Another writer has committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, automatic: bool = True) -> None:
        self.spark, self.files, self.automatic = spark, Files(spark, root), automatic
        self.tables: dict[str, State] = {}
        self.version = 0
        self.refresh()

    # the log

    @staticmethod
    def _log(version: int) -> str:
        return f"_changes/{version:020d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("_changes") if n.endswith(".json")]

    def change(self, version: int) -> dict:
        return self._record(self._log(version))

    def _record(self, name: str) -> dict:
        return unseal(self.files.read(name), name)

    def _checkpoints(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("_checkpoint") if n.endswith(".json")]

    def refresh(self) -> None:
        """Recovery and catching up: the last checkpoint, then every commit after it."""
        points = self._checkpoints()
        if points and points[-1] > self.version:
            found = self._record(f"_checkpoint/{points[-1]:020d}.json")
            self.tables, self.version = {k: load(v) for k, v in found.items()}, points[-1]
        for version in self.versions():
            if version == self.version + 1:
                self.follow(self.change(version))

    def follow(self, change: dict) -> None:
        if change["state"] is None:
            self.tables.pop(change["table"], None)
        else:
            self.tables[change["table"]] = load(change["state"])
        self.version = change["version"]

    def commit(self, table: str, op: str, state: State | None, rows: int = 0) -> None:
        before = self.tables.get(table)
        old = {f.name for x in ([before] if before else []) for f in (*x.files, *x.deletions)}
        change = {"version": self.version + 1, "table": table, "op": op, "rows": rows, "state": dump(state), "added": [f.name for f in (*state.files, *state.deletions) if f.name not in old] if state else []}
        # a name may be free again because a checkpoint has taken over what it held
        if max(self._checkpoints(), default=0) > self.version or not self.files.create(self._log(self.version + 1), seal(change)):
            raise Conflict(f"another writer has committed version {self.version + 1}")
        self.follow(change)
        if self.version % CHECKPOINT_EVERY == 0:
            self.shorten()

    def checkpoint(self) -> None:
        self.files.create(f"_checkpoint/{self.version:020d}.json", seal({k: dump(v) for k, v in self.tables.items()}))

    def shorten(self) -> None:
        """Makes a checkpoint; the log up to CHECKPOINT_EVERY commits before it, and all but two checkpoints, go."""
        self.truncate_log(keep=CHECKPOINT_EVERY)
        for version in self._checkpoints()[:-2]:
            self.files.delete(f"_checkpoint/{version:020d}.json")

    def register(self, replica: str, version: int) -> None:
        """Notes that a replica has applied everything up to a version."""
        before = self.files.names(f"_replicas/{replica}")
        self.files.create(f"_replicas/{replica}/{version:020d}", "")
        for name in before:
            if int(name) < version:
                self.files.delete(f"_replicas/{replica}/{name}")

    def unregister(self, replica: str) -> None:
        self.files.delete(f"_replicas/{replica}")

    def needed_from(self) -> int | None:
        """The first version that a registered replica has still to apply; none if none is registered."""
        have = [max(map(int, names)) for r in self.files.names("_replicas") if (names := self.files.names(f"_replicas/{r}"))]
        return min(have) + 1 if have else None

    def _waiting(self) -> set[str]:
        """Files that a replica has still to copy."""
        first = self.needed_from()
        return {name for v in self.versions() if first is not None and v >= first for name in self.change(v)["added"]}

    def truncate_log(self, needed_from: int | None = None, keep: int = 0) -> None:
        """Drops log files that a new checkpoint covers, but keeps the last `keep` and those from the version that a replica still needs."""
        self.checkpoint()
        if needed_from is None:
            needed_from = self.needed_from()
        for version in self.versions():
            if version <= self.version - keep and (needed_from is None or version < needed_from):
                self.files.delete(self._log(version))

    # reading

    def state(self, table: str) -> State:
        if table not in self.tables:
            raise EngineError(f"unknown table {table}")
        return self.tables[table]

    def read(self, table: str, conditions: list[tuple[str, str, Any]] = (), positions: bool = False) -> DataFrame:
        """The live rows; conditions (column, operator, value) only spare files. positions: with file and row."""
        state = self.state(table)
        names = [f.name for f in state.files if f.may_hold(conditions)]
        if state.partition_by and (mine := [(op, v) for c, op, v in conditions if c == state.partition_by]):
            kept = set(partitions.prune(list(state.partitions), mine))
            names = [f.name for f in state.files if f.partition in kept and f.may_hold(conditions)]
        columns = [c.name for c in state.columns]
        if not names:
            df = self.spark.createDataFrame([], state.schema)
            return df.withColumns({FILE: F.lit(""), ROW: F.lit(0).cast("long")}) if positions else df
        df = self.spark.read.schema(state.schema).parquet(*(self.files.uri(n) for n in names))
        if not state.deletions and not positions:
            return df
        touched = self._touched(state)
        clean = [n for n in names if n not in touched]
        parts = []
        if clean:
            parts.append(self._located(state, clean) if positions else self.spark.read.schema(state.schema).parquet(*(self.files.uri(n) for n in clean)))
        if len(clean) < len(names):
            dead = self.spark.read.schema(f"{FILE} string, {ROW} long").parquet(*(self.files.uri(f.name) for f in state.deletions))
            live = self._located(state, [n for n in names if n in touched]).join(dead, [FILE, ROW], "left_anti")
            parts.append(live if positions else live.select(*columns))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _located(self, state: State, names: list[str]) -> DataFrame:
        """The rows of data files with file and row."""
        df = self.spark.read.schema(state.schema).parquet(*(self.files.uri(n) for n in names))
        return df.select(*(c.name for c in state.columns), F.regexp_extract("_metadata.file_path", r"(data-[0-9a-f]+/.+)$", 1).alias(FILE), F.col("_metadata.row_index").alias(ROW))

    def _touched(self, state: State) -> set[str]:
        """The data files with dead rows; all of them, if a deletion doesn't say of which or names one that isn't here."""
        every = {f.name: f.name.partition("/")[2] for f in state.files}
        known = set(every.values())
        found = {unquote(x) for d in state.deletions for x in d.of}
        if found <= known and all(d.of for d in state.deletions):
            return {name for name, x in every.items() if x in found}
        return set(every) if state.deletions else set()

    # writing

    def _write(self, state: State, df: DataFrame) -> tuple[FileInfo, ...]:
        """Writes rows to new files, clustered by the first index, and by partition where there are some."""
        folder = f"{state.name}/data-{uuid.uuid4().hex}"
        order = list(state.indexes[0].columns) if state.indexes else []
        writer_columns = []
        if state.partition_by:
            df = df.withColumn("__part", partitions.place_column(F.col(state.partition_by), list(state.partitions), literal))
            # rows of one partition may be most of them: leave their spread to the size-aware rebalancing
            df = df.hint("rebalance", "__part")
            order = ["__part", *order]
            writer_columns = ["__part"]
        if order:
            df = df.sortWithinPartitions(*order)
        writer = df.write.option("maxRecordsPerFile", ROWS_PER_FILE)
        for index in state.indexes:
            for c in index.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (writer.partitionBy(*writer_columns) if writer_columns else writer).parquet(self.files.uri(folder))
        names = self.files.parquet(folder)
        part = lambda n: next((x.removeprefix("__part=") for x in n.split("/") if x.startswith("__part=")), None)
        ranges = self._ranges(state, names)
        return tuple(FileInfo(n, part(n), (), ranges.get(n.partition("/")[2], ())) for n in names)

    def _ranges(self, state: State, names: list[str]) -> dict[str, tuple[tuple[str, Any, Any], ...]]:
        """The ranges of new files, one row for each, read from the columns in question only."""
        keyed = {c for x in (*state.constraints, *state.indexes) for c in x.columns}
        some = [c.name for c in state.columns if c.name in keyed and c.type in ("INT", "BIGINT", "DATE", "TIMESTAMP")]
        if not some or not names:
            return {}
        ends = (f(c).alias(f"{end}_{i}") for i, c in enumerate(some) for end, f in (("low", F.min), ("high", F.max)))
        found = self._located(state, names).groupBy(FILE).agg(*ends).collect()
        return {unquote(r[FILE]): tuple((c, r[f"low_{i}"], r[f"high_{i}"]) for i, c in enumerate(some)) for r in found}

    def _delete_rows(self, state: State, where: DataFrame) -> FileInfo:
        """Writes the (file, row) pairs as a deletion file."""
        folder = f"{state.name}/dead-{uuid.uuid4().hex}"
        where.select(FILE, ROW).write.parquet(self.files.uri(folder))
        # as many names as the table has data files at most
        of = self.spark.read.schema(f"{FILE} string").parquet(self.files.uri(folder)).distinct().collect()
        return FileInfo(folder, None, tuple(sorted(r[0] for r in of)))

    def _checked(self, state: State, df: DataFrame, replaced: DataFrame | None = None) -> tuple[FileInfo, ...]:
        """New rows with defaults filled in as files, after all checks; the checks read the files. replaced: rows that go at the same time."""
        files = self._write(state, self._filled(state, df))
        if not files:
            return files
        try:
            self._check(state, self.spark.read.schema(state.schema).parquet(*(self.files.uri(f.name) for f in files)), replaced)
        except Exception:
            self.files.delete("/".join(files[0].name.split("/")[:2]))
            raise
        return files

    @staticmethod
    def _filled(state: State, df: DataFrame) -> DataFrame:
        return df.select(*(F.coalesce(F.col(c.name), literal(c.default)).cast(types.SPARK[c.type]).alias(c.name) if c.default is not None else F.col(c.name).cast(types.SPARK[c.type]).alias(c.name) for c in state.columns))

    def _check(self, state: State, df: DataFrame, replaced: DataFrame | None) -> None:
        tests = {}
        for c in state.columns:
            if c.not_null:
                tests[f"column {c.name} must not be null"] = F.col(c.name).isNull()
            if c.length is not None:
                tests[f"value too long for {c.name} ({c.length} bytes)"] = F.octet_length(c.name) > c.length
        if tests:
            found = df.agg(*(F.max(F.when(t, 1).otherwise(0)).alias(f"t{i}") for i, t in enumerate(tests.values()))).first()
            for message, bad in zip(tests, found, strict=True):
                if bad:
                    raise ConstraintError(message)
        for name, key in state.keys():
            self._unique(state, name, key, df, replaced)

    def _unique(self, state: State, name: str, key: tuple[str, ...], df: DataFrame, replaced: DataFrame | None) -> None:
        """A key with a null in it is exempt."""
        some = df.select(*key).dropna()
        if not some.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
            raise ConstraintError(f"duplicate key for {name}")
        if not state.files:
            return
        old = self.read(state.name, positions=replaced is not None)
        if replaced is not None:
            old = old.join(replaced.select(FILE, ROW), [FILE, ROW], "left_anti")
        if not some.join(old.select(*key).dropna(), list(key), "left_semi").isEmpty():
            raise ConstraintError(f"duplicate key for {name}")

    def create(self, state: State) -> None:
        if state.name in self.tables:
            raise EngineError(f"table {state.name} exists")
        self.commit(state.name, "create", replace(state, epoch=uuid.uuid4().hex))

    def drop(self, table: str) -> None:
        self.state(table)
        waiting = {n.split("/")[0] for n in self._waiting()}
        self.commit(table, "drop", None)
        if table not in waiting:
            self.files.delete(table)

    def alter(self, state: State, op: str) -> None:
        self.commit(state.name, op, state)

    def insert(self, table: str, df: DataFrame) -> int:
        """Appends rows; all or none. Columns by name; those that are missing get their default."""
        state = self.state(table)
        for name in df.columns:
            state.column(name)
        df = df.select(*(F.col(c.name) if c.name in df.columns else F.lit(None).cast(types.SPARK[c.type]).alias(c.name) for c in state.columns))
        files = self._checked(state, df)
        n = self._rows(state, files)
        self.commit(table, "insert", replace(state, files=state.files + files, rows=state.rows + n), n)
        self.upkeep(table)
        return n

    def _rows(self, state: State, files: tuple[FileInfo, ...]) -> int:
        return self.spark.read.schema(state.schema).parquet(*(self.files.uri(f.name) for f in files)).count() if files else 0

    def delete(self, table: str, predicate: Column | None, conditions: list = ()) -> int:
        state = self.state(table)
        if predicate is None:
            n = state.rows - state.dead
            self.commit(table, "delete", replace(state, files=(), deletions=(), rows=0, dead=0), n)
            return n
        dead = self._delete_rows(state, self.read(table, conditions, positions=True).filter(predicate))
        n = self.spark.read.parquet(self.files.uri(dead.name)).count()
        if n:
            self.commit(table, "delete", replace(state, deletions=(*state.deletions, dead), dead=state.dead + n), n)
            self.upkeep(table)
        return n

    def update(self, table: str, sets: dict[str, Column], predicate: Column | None, conditions: list = ()) -> int:
        """Sets see the old row. New rows are checked, with the old ones out of the way, before anything is committed."""
        state = self.state(table)
        old = self.read(table, conditions, positions=True)
        dead = self._delete_rows(state, old if predicate is None else old.filter(predicate))
        pairs = self.spark.read.schema(f"{FILE} string, {ROW} long").parquet(self.files.uri(dead.name))
        n = pairs.count()
        if not n:
            return 0
        new = old.join(pairs, [FILE, ROW], "left_semi").select(*(sets[c.name].cast(types.SPARK[c.type]).alias(c.name) if c.name in sets else F.col(c.name) for c in state.columns))
        files = self._checked(state, new, pairs)
        self.commit(table, "update", replace(state, files=state.files + files, deletions=(*state.deletions, dead), rows=state.rows + n, dead=state.dead + n), n)
        self.upkeep(table)
        return n

    def rewrite(self, table: str, op: str = "vacuum", state: State | None = None) -> int:
        """All live rows into new files; returns how many dead ones went."""
        old = self.state(table)
        state = state or old
        files = self._write(state, self.read(table)) if old.files else ()
        self.commit(table, op, replace(state, files=files, deletions=(), rows=old.rows - old.dead, dead=0), old.dead)
        return old.dead

    def upkeep(self, table: str) -> None:
        """Vacuums or compacts when a statement has left enough behind."""
        state = self.state(table)
        if self.automatic and state.rows and (state.dead / state.rows > DEAD_SHARE or len(state.files) >= MANY_FILES and len(state.files) > 2 * max(1, state.rows // ROWS_PER_FILE)):
            self.rewrite(table, "merge")

    def clean(self, table: str) -> int:
        """Deletes files of a table (a dropped one too) that its state does not name (those of older versions and of failed writes) and no replica waits for."""
        state = self.tables.get(table)
        named = [f.name for f in (*state.files, *state.deletions)] if state else []
        named += [n for n in self._waiting() if n.startswith(f"{table}/")]
        used = {n.split("/")[1] for n in named}
        gone = [x for x in self.files.names(table) if x not in used]
        for x in gone:
            self.files.delete(f"{table}/{x}")
        return len(gone)
