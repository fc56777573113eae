"""The memory store: versioned Parquet snapshots with a manifest, named checkpoints, and ordered merges."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memtide.functions.lifecycle import accessed, memory_key
from memtide.functions.vec import norm
from memtide.plans.lineage import cut, scope
from memtide.plans.ranks import numbered
from memtide.sources import schemas

_NAME = re.compile(r"[a-zA-Z0-9_-]+").fullmatch


def valid_name(name: str) -> str:
    if not _NAME(name or ""):
        raise ValueError(f"bad checkpoint name {name!r}: letters, digits, dash and underscore only")
    return name


def sandboxed(root: str, relative: str) -> str:
    """A path below ``root``; absolute and escaping ones are refused."""
    parts = relative.split("/")
    if relative.startswith("/") or ":" in relative or ".." in parts:
        raise ValueError(f"path {relative!r} leaves the store")
    return f"{root}/{relative}"


def merge_memories(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """Ordered union by text and time of creation: rows on disk win and keep their positions; new rows, in their order,
    get the positions after the largest on disk."""
    both = disk.withColumn("_src", F.lit(0)).unionByName(memory.withColumn("_src", F.lit(1)))
    first = Window.partitionBy(memory_key(F.col("text"), F.col("created_at").cast("string"))).orderBy("_src", "pos")
    kept = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    new = numbered(kept.where("_src = 1").drop("_src"), "_at", "pos", F.xxhash64("text"))
    end = disk.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_end"))  # one row
    new = new.crossJoin(F.broadcast(end)).withColumn("pos", F.col("_end") + F.col("_at")).select(*disk.columns)
    return kept.where("_src = 0").select(*disk.columns).unionByName(new)


def merged(disk: DataFrame, new: DataFrame, most: int = 10_000) -> DataFrame:
    """The last ``most`` rows of :func:`merge_memories`. Where there are more, their positions alone are put in order, by
    ranges; no task gathers the rows."""
    whole = cut(merge_memories(disk, new))
    if whole.count() <= most:
        return whole
    key = memory_key(F.col("text"), F.col("created_at").cast("string"))  # no two rows share it
    edge = numbered(whole.select("pos", key.alias("_key")), "_place", F.col("pos").desc(), "_key").where(F.col("_place") == most).first()
    return whole.where((F.col("pos") > edge["pos"]) | ((F.col("pos") == edge["pos"]) & (key < edge["_key"])))


def with_counter(counters: DataFrame, **values: int) -> DataFrame:
    """``counters`` with some set anew."""
    return counters.where(~F.col("name").isin(*values)).unionByName(counters.sparkSession.createDataFrame(list(values.items()), schemas.COUNTER))


def counter(counters: DataFrame, name: str) -> int | None:
    return counters.where(F.col("name") == name).agg(F.max("value")).first()[0]


def bounded(memories: DataFrame, most: int = 10_000, by: str = "workspace") -> DataFrame:
    """The last ``most`` rows of each workspace."""
    newest = Window.partitionBy(by).orderBy(F.col("pos").desc())
    return memories.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def update_skills(old: DataFrame, new: DataFrame) -> DataFrame:
    """As :func:`upsert_skills`, for skills that must be there: an id that is not is an error."""
    absent = [r["id"] for r in new.join(old.select("id"), "id", "left_anti").select("id").limit(5).collect()]
    if absent:
        raise KeyError(f"no skill {absent[0]!r}" if len(absent) == 1 else f"no skills {absent}")
    return upsert_skills(old, new)


def upsert_skills(old: DataFrame, new: DataFrame) -> DataFrame:
    """Skills of ``new`` replace those with the same id and go to the end; creation times stay."""
    born = old.select("id", F.col("created_at").alias("_born"))
    fresh = new.join(born, "id", "left").withColumn("created_at", F.coalesce("_born", "created_at")).select(*new.columns)
    return old.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(fresh)


def deprecate_skills(skills: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return skills.join(gone, "id", "left").withColumn("deprecated", F.col("deprecated") | F.coalesce("_gone", F.lit(False))).select(*skills.columns)


class Repository(Protocol):
    """What the facade needs of a store: tables by name, and snapshots of all of them."""

    def read(self, table: str) -> DataFrame: ...

    def write(self, table: str, df: DataFrame) -> None: ...

    def merge(self, memories: DataFrame) -> None: ...

    def touch(self, ids: DataFrame, now: Column) -> None: ...

    def commit(self, make: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]) -> None: ...

    def recover(self) -> dict[str, str]: ...

    def step(self) -> int: ...

    def set_step(self, value: int) -> None: ...

    def checkpoint(self, name: str) -> str: ...

    def checkpoints(self) -> list[str]: ...

    def restore(self, name: str) -> None: ...

    def forget(self) -> None: ...

    def status(self) -> dict[str, object]: ...


class Store:
    """Tables of a workspace under one root. A write makes a new version and then a new manifest that points at it.

    Accesses to memories are appended: a version of that table is a list of parts, and a touch writes a part with the
    positions it names, whatever the size of the memories. Reading memories adds the accesses up, and so any new version of
    the memories has them and starts with none.
    """

    #: Parts of accesses that a read puts together; the touch after that folds them into the memories.
    MAX_PARTS = 64
    TABLES = {"accesses": schemas.ACCESS, "memories": schemas.MEMORY, "prototypes": schemas.PROTOTYPE, "skills": schemas.SKILL, "transitions": schemas.EDGE, "events": schemas.EVENT, "counters": schemas.COUNTER}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> str:
        return sandboxed(self.root, f"_manifests/{valid_name(name)}")

    def _latest(self, name: str) -> tuple[int, dict[str, str]]:
        """The number and the pointers of the newest manifest that can be read; number 0 if there is none.

        A manifest is a file of its own, so a writer that dies half-way leaves the one before in force.
        """
        folder = self._path(self._folder(name))
        found = [s.getPath() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = sorted((int(p.getName()) for p in found if p.getName().isdigit()), reverse=True)
        for number in numbers:
            rows = self.spark.read.text(f"{self._folder(name)}/{number:012d}", wholetext=True).collect()  # a few hundred bytes
            try:
                pointers = json.loads(rows[0]["value"]) if rows else None
            except ValueError:
                pointers = None
            if isinstance(pointers, dict):
                return numbers[0], pointers
        return numbers[0] if numbers else 0, {}

    def _pointers(self, name: str) -> dict[str, str]:
        return self._latest(name)[1]

    def _point(self, name: str, pointers: dict[str, str], after: int | None = None) -> bool:
        """Write the manifest that follows number ``after``; False if another writer was first."""
        number = (self._latest(name)[0] if after is None else after) + 1
        try:
            out = self._fs.create(self._path(f"{self._folder(name)}/{number:012d}"), False)
        except Py4JJavaError as error:
            if "already exists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(pointers, sort_keys=True).encode()))
        out.close()
        return True

    def _change(self, table: str, make: Callable[[dict[str, str]], DataFrame], tries: int = 20) -> None:
        """Write ``make(pointers)`` as the new version of a table; made anew when another writer was first."""
        self._commit(lambda now: {table: make(now)}, tries)

    def _commit(self, make: Callable[[dict[str, str]], dict[str, DataFrame]], tries: int = 20, append: bool = False) -> None:
        """Write new versions of some tables, ``make(pointers)``, under one manifest: either all count or none. They are made
        anew when another writer has changed one of them meanwhile. ``append``: what is made comes beside what is there."""
        for _ in range(tries):
            number, pointers = self._latest("current")
            versions, new = {}, make(pointers)
            if not new:
                return
            for table, df in new.items():
                part = uuid.uuid4().hex
                df.write.parquet(sandboxed(self.root, f"{table}/{part}"))
                versions[table] = ",".join(filter(None, [pointers.get(table), part])) if append else part
            if "memories" in versions:
                versions["accesses"] = ""
            while True:
                if self._point("current", pointers | versions, number):
                    return
                number, now = self._latest("current")
                if any((now.get(t) or "") != (pointers.get(t) or "") for t in versions):
                    break
                pointers = now
        raise RuntimeError(f"{sorted(versions)}: other writers were first {tries} times")

    def commit(self, make: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]) -> None:
        """``make(read)`` gives new versions of some tables from the current ones; all are in force at once, or none."""
        self._commit(lambda now: make(lambda table: self._read(table, now)))

    def read(self, table: str, name: str = "current") -> DataFrame:
        """The current version; an empty table where there is none."""
        return self._read(table, self._pointers(name))

    def _read(self, table: str, pointers: dict[str, str]) -> DataFrame:
        schema = self.TABLES[table]
        paths = [sandboxed(self.root, f"{table}/{version}") for version in (pointers.get(table) or "").split(",") if version]
        if not paths or not all(self._fs.exists(self._path(p)) for p in paths):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(*paths)
        missing = set(self.spark.createDataFrame([], schema).columns) - set(found.columns)
        if missing:
            raise ValueError(f"{table} lacks {sorted(missing)}")
        return accessed(found, self._read("accesses", pointers)) if table == "memories" and pointers.get("accesses") else found

    def recover(self) -> dict[str, str]:
        """Reset tables whose files can't be read to empty ones; what failed, by table. The others stay as they are."""
        errors = {}
        for table in self.TABLES:
            try:
                self.read(table).count()
            except Exception as error:  # noqa: BLE001  whatever the reader says of broken files
                errors[table] = f"{type(error).__name__}: {str(error).splitlines()[0][:300]}"
                self.write(table, self.spark.createDataFrame([], self.TABLES[table]))
        return errors

    def write(self, table: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(sandboxed(self.root, f"{table}/{version}"))
        new = {table: version} | ({"accesses": ""} if table == "memories" else {})
        while True:
            number, pointers = self._latest("current")
            if self._point("current", pointers | new, number):
                return

    def touch(self, ids: DataFrame, now: Column) -> None:
        """One more access, at ``now``, for each memory whose ``pos`` is in ``ids``; null and unknown ones have no effect.

        What is written grows with ``ids`` alone. A position counts once a call."""
        if self._pointers("current").get("accesses", "").count(",") + 1 >= self.MAX_PARTS:
            self.commit(lambda read: {"memories": read("memories")})
        hit = ids.select(F.col("pos").cast("bigint").alias("pos")).where("pos is not null").distinct()
        place = lambda pointers: F.lit(len(pointers.get("accesses") or "")).cast("bigint")  # noqa: E731  grows with each part
        self._commit(lambda pointers: {"accesses": hit.select("pos", now.alias("at"), place(pointers).alias("seq"))}, append=True)

    def merge(self, memories: DataFrame, most: int = 10_000) -> None:
        """Read, merge, bound and write: rows that another writer has stored meanwhile stay."""
        with scope():
            new = cut(memories)
            self.commit(lambda read: {"memories": merged(read("memories"), new, most)})

    def checkpoint(self, name: str) -> str:
        while not self._point(valid_name(name), self._pointers("current")):
            pass
        return name

    def checkpoints(self) -> list[str]:
        folder = self._path(sandboxed(self.root, "_manifests"))
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName() != "current" and "." not in s.getPath().getName())

    def restore(self, name: str) -> None:
        """Back to a checkpoint; tables it lacks become empty."""
        if name not in self.checkpoints():
            raise FileNotFoundError(f"no checkpoint {name!r}; there are {self.checkpoints()}")
        while not self._point("current", self._pointers(name)):
            pass

    def forget(self) -> None:
        """Empty memories and prototypes; what was stored does not come back."""
        for table in ("memories", "prototypes"):
            self.write(table, self.spark.createDataFrame([], self.TABLES[table]))

    def step(self) -> int:
        """How many times the prototypes have learned."""
        return counter(self.read("counters"), "step") or 0

    def set_step(self, value: int) -> None:
        self.write("counters", with_counter(self.read("counters"), step=value))

    def status(self) -> dict[str, object]:
        """Counts, the share of prototypes in use, the step and the checkpoints in order of their names."""
        protos = self.read("prototypes")
        used = protos.agg(F.avg((norm(F.col("vec")) > 0.03).cast("double"))).first()[0]
        return {"workspace": self.root, "memory_count": self.read("memories").count(), "prototypes": protos.count(), "capacity_usage": used or 0.0, "skills": self.read("skills").count(), "step": self.step(), "checkpoints": self.checkpoints()}

    def export_json(self, path: str) -> None:
        self.read("memories").write.mode("overwrite").json(path)
