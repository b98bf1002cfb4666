"""Versioned tables: immutable Parquet files that commits add, and tables of removed rows that commits add beside them.

A snapshot is what the log says up to a version: the rows of the added files without those that a removal names. A row is
named by its file and its place in it, which never change. A transaction writes its files at once and its log entry at
the end; until then, nobody else reads them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import DuplicateKey, EngineError, NotFound, Status, TxnConflict, TypeMismatch
from tessera.functions.expressions import family
from tessera.store.files import Files
from tessera.store.log import Log, TableState, apply

TYPES = {"INT": T.IntegerType(), "FLOAT": T.FloatType(), "BOOL": T.BooleanType(), "VARCHAR": T.StringType()}
FILE, ROW = "_file", "_row"
#: Commits after which the tables' state is written down, so that a reader replays at most as many entries.
CHECKPOINT_EVERY = 20
#: Seconds after which a version that was claimed but not published counts as given up; publishing takes one rename.
CLAIM_SECONDS = 60.0


def schema_of(columns: list[dict]) -> T.StructType:
    """Nullable for Spark throughout: NOT NULL is checked on the way in, and files say nothing of it."""
    return T.StructType([T.StructField(c["name"], TYPES[c["type"]], True, {"varchar_len": c["length"], "primary_key": c["primary_key"], "not_null": not c["nullable"]}) for c in columns])


@dataclass
class Txn:
    id: int
    snapshot: int
    isolation: str = "snapshot"
    actions: list[dict] = field(default_factory=list)
    state: str = "ACTIVE"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.log = Log(self.files)
        self._next = 1
        self.active: dict[int, Txn] = {}

    # transactions

    def begin(self, isolation: str = "snapshot") -> Txn:
        if isolation not in ("snapshot", "serializable"):
            raise EngineError(f"no isolation level {isolation}")
        txn = Txn(self._next, self.log.last(), isolation)
        self._next += 1
        self.active[txn.id] = txn
        return txn

    def rollback(self, txn: Txn) -> None:
        for action in txn.actions:
            if "path" in action:
                self.files.delete(action["path"])
        txn.actions, txn.state = [], "ABORTED"
        self.active.pop(txn.id, None)

    def commit(self, txn: Txn) -> int:
        """The version that now holds the transaction's work, or the snapshot's where it did none."""
        if not txn.actions:
            txn.state = "COMMITTED"
            self.active.pop(txn.id, None)
            return txn.snapshot
        seen = txn.snapshot
        while True:
            last = self.log.last()
            try:
                lost = [a["path"] for a in txn.actions if "path" in a and not self.files.exists(a["path"])]
                if lost:
                    raise EngineError(f"files of the transaction are gone: {', '.join(lost)}", Status.IO_ERROR)
                for version in range(seen + 1, last + 1):
                    self._check(txn, version)
            except EngineError:
                self.rollback(txn)
                raise
            seen = last
            if self.log.append(last + 1, {"txn": txn.id, "kind": "COMMIT", "actions": txn.actions}):
                txn.state = "COMMITTED"
                self.active.pop(txn.id, None)
                if (last + 1) % CHECKPOINT_EVERY == 0:
                    self.log.checkpoint(last + 1)
                return last + 1
            if self.log.last() == last:
                raise EngineError("another writer holds the next version; recover() clears one that died there", Status.IO_ERROR)

    def _check(self, txn: Txn, version: int) -> None:
        """Does a commit after the snapshot stand against ours? The first to commit wins."""
        mine: dict[str, list[dict]] = {}
        for action in txn.actions:
            mine.setdefault(action["table"], []).append(action)
        for action in (self.log.entry(version) or {"actions": []})["actions"]:
            ours = mine.get(action["table"])
            if not ours:
                continue
            kinds = {a["do"] for a in ours}
            if action["do"] in ("create", "drop", "rewrite") or kinds & {"create", "drop", "rewrite"}:
                raise TxnConflict(f"{action['table']} was changed by version {version}")
            if txn.isolation == "serializable":
                raise TxnConflict(f"{action['table']} was written by version {version}")
            if action["do"] == "remove" and "remove" in kinds:
                gone = self._removals([a["path"] for a in ours if a["do"] == "remove"])
                if not gone.join(self._removals([action["path"]]), [FILE, ROW], "left_semi").isEmpty():
                    raise TxnConflict(f"a row of {action['table']} was removed by version {version}")
            if action["do"] == "add" and "add" in kinds:
                columns = self.log.state(version)[action["table"]].columns
                keys = [c["name"] for c in columns if c["primary_key"]]
                if keys:
                    added = self._rows(columns, [a["path"] for a in ours if a["do"] == "add"])
                    if not added.join(self._rows(columns, [action["path"]]), keys, "left_semi").isEmpty():
                        raise DuplicateKey(f"version {version} has a row of {action['table']} with this key")

    # reading

    def tables(self, txn: Txn | None = None, version: int | None = None) -> dict[str, TableState]:
        state = self.log.state(txn.snapshot if txn else version)
        if txn:
            apply(state, {"actions": txn.actions}, txn.snapshot)
        return state

    def table(self, name: str, txn: Txn | None = None, version: int | None = None) -> TableState:
        found = self.tables(txn, version).get(name)
        if found is None:
            raise NotFound(f"no table {name}")
        return found

    def _rows(self, columns: list[dict], paths: list[str]) -> DataFrame:
        schema = schema_of(columns)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.files.at(p) for p in paths])

    def _removals(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{FILE} string, {ROW} long").parquet(*[self.files.at(p) for p in paths])

    def snapshot(self, name: str, txn: Txn | None = None, version: int | None = None, with_rid: bool = False) -> DataFrame:
        """The table as ``txn`` sees it (its own writes too), or at a version, or now."""
        state = self.table(name, txn, version)
        rows = self._rows(state.columns, state.added)
        names = [c["name"] for c in state.columns]
        if not state.added:
            return rows.select(*[F.col(f"`{n}`") for n in names], *([F.lit("").alias(FILE), F.lit(0).cast("long").alias(ROW)] if with_rid else []))
        if not state.removed and not with_rid:
            return rows
        named = rows.select(*[F.col(f"`{n}`") for n in names], F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1).alias(FILE), F.col("_metadata.row_index").alias(ROW))
        if state.removed:
            named = named.join(self._removals(state.removed), [FILE, ROW], "left_anti")
        return named.select(*[F.col(f"`{n}`") for n in names], *([FILE, ROW] if with_rid else []))

    # writing

    def create(self, txn: Txn, name: str, columns: list[dict]) -> None:
        seen = [c["name"] for c in columns]
        if len(set(seen)) < len(seen):
            raise EngineError(f"{name} has two columns of one name")
        if name in self.tables(txn):
            raise EngineError(f"{name} exists already", Status.DUPLICATE_KEY)
        txn.actions.append({"do": "create", "table": name, "id": uuid.uuid4().hex, "columns": columns})

    def drop(self, txn: Txn, name: str) -> None:
        self.table(name, txn)
        txn.actions.append({"do": "drop", "table": name})

    def _new_path(self, state: TableState, kind: str) -> str:
        return f"tables/{state.id}/{kind}-{uuid.uuid4().hex}"

    def append(self, txn: Txn, name: str, rows: DataFrame) -> None:
        """Add rows (all columns, in any order) after coercion and the NOT NULL and PRIMARY KEY checks."""
        state = self.table(name, txn)
        made = coerced(rows, state.columns)
        path = self._new_path(state, "rows")
        try:
            keys = [c["name"] for c in state.columns if c["primary_key"]]
            # In the order of the key, so that the statistics of a file's row groups tell its ranges apart.
            write_ordered(made, self.files.at(path), keys[0]) if keys else made.write.parquet(self.files.at(path))
            self._check_new(name, state, self._rows(state.columns, [path]), txn)
        except BaseException:
            self.files.delete(path)
            raise
        txn.actions.append({"do": "add", "table": name, "path": path})

    def _check_new(self, name: str, state: TableState, new: DataFrame, txn: Txn) -> None:
        needed = [c["name"] for c in state.columns if not c["nullable"]]
        if needed and not new.filter(" or ".join(f"`{n}` is null" for n in needed)).isEmpty():
            raise EngineError(f"a row without {' or '.join(needed)} for {name}")
        keys = [c["name"] for c in state.columns if c["primary_key"]]
        if keys:
            quoted = [F.col(f"`{k}`") for k in keys]
            if not new.groupBy(*quoted).count().filter("count > 1").isEmpty():
                raise DuplicateKey(f"two new rows of {name} with one key")
            if state.added:
                # The range of the new keys is pushed to the scan of the old ones.
                low, high = new.agg(F.min(quoted[0]), F.max(quoted[0])).first()
                old = self.snapshot(name, txn).filter(quoted[0].between(F.lit(low), F.lit(high))) if low is not None else self.snapshot(name, txn)
                if not new.join(old, keys, "left_semi").isEmpty():
                    raise DuplicateKey(f"{name} has a row with this key")

    def delete(self, txn: Txn, name: str, condition: Column | None) -> int:
        """Remove the rows for which the condition is true; how many there were."""
        state = self.table(name, txn)
        rows = self.snapshot(name, txn, with_rid=True).alias(name)
        gone = (rows if condition is None else rows.filter(condition)).select(FILE, ROW)
        path = self._new_path(state, "gone")
        try:
            gone.write.parquet(self.files.at(path))
        except BaseException:
            self.files.delete(path)
            raise
        count = self._removals([path]).count()
        if count:
            txn.actions.append({"do": "remove", "table": name, "path": path})
        else:
            self.files.delete(path)
        return count

    def rewrite(self, txn: Txn, name: str, sort_by: str | None = None) -> None:
        """Write the snapshot anew as one set of files, without removed rows; in the order of a column if one is named."""
        state = self.table(name, txn)
        rows, path = self.snapshot(name, txn), self._new_path(state, "rows")
        write_ordered(rows, self.files.at(path), sort_by)
        txn.actions.append({"do": "rewrite", "table": name, "path": path})

    # upkeep

    def vacuum(self, keep_from: int | None = None, grace: float = 86_400.0) -> list[str]:
        """Delete the files that no version from ``keep_from`` (by default the last) on reads, and none of an active transaction; of those
        that no commit names, only such as are older than ``grace`` seconds."""
        last = self.log.last()
        versions = range(last if keep_from is None else keep_from, last + 1)
        needed = {p for v in versions for t in self.log.state(v).values() for p in (*t.added, *t.removed)}
        needed |= {p for txn in self.active.values() for t in self.tables(txn).values() for p in (*t.added, *t.removed)}
        return self._sweep(needed, grace)

    def _named(self) -> set[str]:
        return {a["path"] for v in self.log.versions() for a in (self.log.entry(v) or {"actions": []})["actions"] if "path" in a}

    def _sweep(self, needed: set[str], grace: float) -> list[str]:
        dropped, named = [], self._named()
        for table in self.files.names("tables"):
            for name in self.files.names(f"tables/{table}"):
                path = f"tables/{table}/{name}"
                if path not in needed and (path in named or grace <= 0 or self.files.age(path) >= grace):
                    self.files.delete(path)
                    dropped.append(path)
        return dropped

    def recover(self, grace: float = 0.0) -> dict[str, list]:
        """What a crash left: a torn last entry goes, and so do files of transactions that never published theirs. Whatever is younger
        than ``grace`` seconds may be a live writer's and stays."""
        torn = []
        for name in self.files.names("log"):
            unpublished = name.endswith(".draft") or (name.endswith(".claim") and not self.files.exists(f"log/{name[:-6]}"))
            if unpublished and (grace <= 0 or self.files.age(f"log/{name}") >= min(grace, CLAIM_SECONDS)):
                self.files.delete(f"log/{name}")
        last = self.log.last()
        if last and self.log.entry(last) is None:
            torn.append(last)
            self.files.delete(f"log/{last:020d}.json")
            self.files.delete(f"log/{last:020d}.json.claim")
        losers = self._sweep(self._named() | {p for t in self.active.values() for a in t.actions if "path" in a for p in [a["path"]]}, grace)
        return {"torn": torn, "undone": losers}


def write_ordered(rows: DataFrame, path: str, sort_by: str | None) -> None:
    """Files whose key ranges do not overlap, with statistics and a bloom filter of the key, for point and range reads."""
    if sort_by is None:
        rows.write.parquet(path)
        return
    key = F.col(f"`{sort_by}`")
    writer = rows.repartitionByRange(key).sortWithinPartitions(key).write
    writer.option("parquet.bloom.filter.enabled#" + sort_by, "true").parquet(path)


def coerced(rows: DataFrame, columns: list[dict]) -> DataFrame:
    """Numbers become the column's kind of number, and strings are cut to the column's length (in characters)."""
    out = []
    for c in columns:
        if c["name"] not in rows.columns:
            out.append(F.lit(None).cast(TYPES[c["type"]]).alias(c["name"]))
            continue
        column, found = F.col(f"`{c['name']}`"), family(rows.schema[c["name"]].dataType)
        wanted = {"INT": "number", "FLOAT": "number", "BOOL": "bool", "VARCHAR": "string"}[c["type"]]
        if found not in (wanted, "null"):
            raise TypeMismatch(f"{found} for {c['name']} {c['type']}")
        column = column.cast(TYPES[c["type"]])
        if c["type"] == "VARCHAR":
            column = F.substring(column, 1, c["length"])
        out.append(column.alias(c["name"]))
    unknown = set(rows.columns) - {c["name"] for c in columns}
    if unknown:
        raise EngineError(f"no column {', '.join(sorted(unknown))}")
    return rows.select(*out)
