"""Stored spaces: every statement that changes a space is committed to a folder, from which the space is opened again.

A commit writes the tables that changed since the last one into new folders and then a manifest of the next number, which
names the folders of all tables; it counts once that manifest is whole, so a reader sees all of a statement or nothing.
Of a frame with changes beside it (Layered) only the changes are written; compact() merges them and vacuum() deletes
folders that the newest manifest no longer names. One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from knotwork.errors import QueryError
from knotwork.operators.temporal import Grown
from knotwork.sources.graph import EDGE_KEY, Layered, Space, remove
from knotwork.sources.manifest import declared, put_table, read_json, read_table, tables, undeclared, write_json

VERSION = 1


class Store:
    """The folder of one space: a URI that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.number = spark, folder.rstrip("/"), None
        #: By table: the objects that the last commit wrote and the entry that names their folders.
        self.known: dict[str, tuple] = {}

    def numbers(self) -> list[int]:
        """The numbers of the whole manifests."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        found = [f.getPath() for f in fs.listStatus(at)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def open(self, number: int | None = None) -> Space:
        """The space as of the newest commit, or as of one given."""
        numbers = self.numbers()
        if not numbers or number is not None and number not in numbers:
            raise QueryError(f"there is no such space at {self.folder}")
        self.number = numbers[-1]
        m = read_json(self.spark, f"{self.folder}/manifests/{number or self.number}")
        if m["version"] != VERSION:
            raise QueryError("the stored space has another version")
        space = undeclared(self.spark, m["space"])
        self.known = {}
        for name, entry in m["tables"].items():
            found = self._made(name, *(self._read(entry[k]) if entry.get(k) else None for k in ("base", "changes")))
            put_table(space, name, found)
            self.known[name] = (self._parts(found), entry)
        return space

    def _read(self, entry: list) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/data/{entry[0]}", entry[1])

    def _write(self, df: DataFrame) -> list:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{name}")
        return [name, df._jdf.schema().json()]

    @staticmethod
    def _parts(found) -> tuple:
        return (found.base, found.changes) if isinstance(found, Layered) else (found.base, found.added) if isinstance(found, Grown) else (found, None)

    @staticmethod
    def _made(name: str, base, changes):
        if changes is None:
            return base
        return Grown(base, changes, 0) if name.startswith("history/") else Layered(base, changes, ("vid",) if name.startswith("tag/") else EDGE_KEY, 0)

    def commit(self, space: Space) -> Space:
        """Writes what changed and returns the space as it reads what was written."""
        made = space.copy()
        for group in (made.tag_history, made.edge_history):
            group |= {n: h() for n, h in group.items() if callable(h)}
        frames = tables(made)
        for kind, group in (("tag", made.tag_frames), ("edge", made.edge_frames), ("history/tag", made.tag_history), ("history/edge", made.edge_history)):
            frames |= {f"{kind}/{n}": f for n, f in group.items() if f"{kind}/{n}" in frames and isinstance(f, Layered | Grown)}
        entries, now = {}, {}
        for name, found in frames.items():
            old, known = self.known.get(name, ((None, None), {}))
            entry, parts = {}, []
            for k, part, before in zip(("base", "changes"), self._parts(found), old, strict=True):
                if part is None:
                    parts.append(None)
                    continue
                entry[k] = known[k] if part is before else self._write(part)
                parts.append(part if part is before else self._read(entry[k]))
            stored = self._made(name, *parts)
            put_table(made, name, stored)
            entries[name], now[name] = entry, (self._parts(stored), entry)
        number = (self.number or max(self.numbers(), default=0)) + 1
        write_json(self.spark, {"version": VERSION, "tables": entries, "space": declared(made)}, f"{self.folder}/manifests/{number}")
        self.number, self.known = number, now
        return made

    def compact(self) -> Space:
        """Merges all changes into their frames, commits, and returns the space."""
        space = self.open()
        for name, df in tables(space).items():
            put_table(space, name, df)
        return self.commit(space)

    def vacuum(self) -> int:
        """Deletes what the newest manifest does not name; older commits cannot be opened any more. Returns the folders deleted."""
        jvm, newest = self.spark._jvm, self.numbers()[-1]
        m = read_json(self.spark, f"{self.folder}/manifests/{newest}")
        used = {entry[k][0] for entry in m["tables"].values() for k in ("base", "changes") if entry.get(k)}
        gone = 0
        for below, keep in (("manifests", {str(newest)}), ("data", used)):
            at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")
            for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at) if used or below == "manifests" else ():
                if f.getPath().getName() not in keep:
                    remove(self.spark, f.getPath().toString())
                    gone += 1
        return gone
