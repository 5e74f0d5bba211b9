"""A table of immutable Parquet folders under a log of versions, with deletion bitmaps.

A version is a small JSON file in ``_log`` that names the folders of data and of deletions that are in it. A writer
puts its folders beside the others and then the next version's file, which only succeeds where that file
isn't there yet; who comes second reads the new version and tries again. So a change is seen as a whole or not at
all, readers of a version never see another, and two writers lose nothing.

A delete doesn't rewrite data: it writes one bitmap for each 32,768 rows of a file that it touches, which
readers join to the rows by file and place. An upsert is such a delete and an append in one version. ``compact``
writes the rows that are left to a new folder, ``vacuum`` removes folders that no kept version names.

The file system must move a file atomically and refuse to move it onto another, as HDFS does (a local one
is served by hard links). Results in special cases: a predicate that is null deletes nothing; null keys
replace each other; an append of no rows is a version; a table without rows reads as empty; a version that
isn't there is an error; columns are matched by name, missing ones are null, unknown ones an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.storage import discard, file_system, materialize, remove

#: Rows of a file that a bitmap stands for, and how often a change is tried while others come first.
ROWS, TRIES = 32_768, 50
FILE, PLACE = "__file", "__place"


@dataclass(frozen=True)
class Version:
    """What a version holds: names of folders, and the change that made it."""

    number: int
    schema: str
    data: tuple[str, ...] = ()
    deletions: tuple[str, ...] = ()
    change: str = "create"
    counts: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"number": self.number, "schema": self.schema, "data": self.data, "deletions": self.deletions, "change": self.change, "counts": self.counts})


class Conflict(RuntimeError):
    """A change didn't get in within ``TRIES`` tries."""


class LogTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str) -> LogTable:
        """A new, empty table; an error where one is."""
        out = cls(spark, path)
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not out._put(Version(0, kind.json())):
            raise ValueError(f"there is a table at {path}")
        return out

    # versions

    def _file(self, number: int) -> str:
        return f"{self.path}/_log/{number:020d}.json"

    def versions(self) -> list[int]:
        fs, make = file_system(self.spark, self.path)
        found = fs.globStatus(make(f"{self.path}/_log/*.json"))
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in found or [])

    def version(self, number: int | None = None) -> Version:
        if number is None:
            known = self.versions()
            if not known:
                raise ValueError(f"there is no table at {self.path}")
            number = known[-1]
        fs, make = file_system(self.spark, self.path)
        at = make(self._file(number))
        if not fs.exists(at):
            raise ValueError(f"there is no version {number}")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Version(raw["number"], raw["schema"], tuple(raw["data"]), tuple(raw["deletions"]), raw["change"], raw["counts"])

    def _put(self, version: Version) -> bool:
        """Write a version's file unless it is there; False if it is."""
        fs, make = file_system(self.spark, self.path)
        to, part = make(self._file(version.number)), make(f"{self.path}/_log/.{uuid.uuid4().hex}.part")
        fs.mkdirs(to.getParent())
        stream = fs.create(part, False)
        stream.write(bytearray(version.text().encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                nio = self.spark.sparkContext._jvm.java.nio.file
                paths = [self.spark.sparkContext._jvm.java.io.File(x.toUri().getPath()).toPath() for x in (to, part)]
                try:
                    nio.Files.createLink(*paths)
                    return True
                except Exception as e:  # a Java exception, by its class
                    if "FileAlreadyExistsException" in str(e):
                        return False
                    raise
            return not fs.exists(to) and fs.rename(part, to)
        finally:
            fs.delete(part, False)

    def _change(self, name: str, make: Callable[[Version], Version]) -> Version:
        """Try ``make`` on the newest version until its result becomes the next one."""
        for _ in range(TRIES):
            now = self.version()
            new = replace(make(now), number=now.number + 1, change=name)
            if self._put(new):
                return new
        raise Conflict(f"{name} came too late {TRIES} times")

    # reading

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.version().schema))

    def _placed(self, version: Version) -> DataFrame:
        """Live rows of a version with their file and their place in it."""
        kind = T.StructType.fromJson(json.loads(version.schema))
        if not version.data:
            empty = self.spark.createDataFrame([], kind)
            return empty.withColumns({FILE: F.lit(None).cast("string"), PLACE: F.lit(None).cast("long")})
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/data/{x}" for x in version.data])
        rows = rows.select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(PLACE))
        if not version.deletions:
            return rows
        bits = self.spark.read.parquet(*[f"{self.path}/deletions/{x}" for x in version.deletions])
        bits = bits.groupBy(F.col("file").alias("__of"), F.col("part").alias("__part")).agg(F.expr("bitmap_or_agg(bits)").alias("__bits"))
        same = (F.col(FILE) == F.col("__of")) & (F.floor(F.col(PLACE) / ROWS) == F.col("__part"))
        byte = f"cast(conv(hex(substring(__bits, cast({PLACE} % {ROWS} div 8 as int) + 1, 1)), 16, 10) as int)"
        gone = F.col("__bits").isNotNull() & (F.expr(f"shiftright({byte}, cast({PLACE} % 8 as int)) & 1") == 1)
        return rows.join(bits, same, "left").filter(~gone).drop("__of", "__part", "__bits")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._placed(self.version(number)).drop(FILE, PLACE)

    def history(self) -> list[Version]:
        return [self.version(n) for n in self.versions()]

    # changes

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        """A new data folder with ``rows`` in the table's columns, and their number."""
        kind = self.schema()
        unknown = set(rows.columns) - set(kind.names)
        if unknown:
            raise ValueError(f"columns that the table lacks: {sorted(unknown)}")
        name = uuid.uuid4().hex
        shaped = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        shaped.write.parquet(f"{self.path}/data/{name}")
        return name, self.spark.read.schema(kind).parquet(f"{self.path}/data/{name}").count()

    def append(self, rows: DataFrame) -> Version:
        """Add rows; they are written once, however often the commit is tried."""
        name, n = self._write(rows)
        return self._change("append", lambda now: replace(now, data=(*now.data, name), counts={"added": n}))

    def _bitmaps(self, found: DataFrame) -> tuple[str | None, int]:
        """A new folder of deletion bitmaps for rows (file, place), and the number of rows; none where there are none."""
        parts = found.groupBy(F.col(FILE).alias("file"), F.floor(F.col(PLACE) / ROWS).alias("part"))
        bits = materialize(parts.agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({PLACE} + 1))").alias("bits"), F.count("*").alias("n")), "bitmaps")
        n = bits.agg(F.sum("n")).first()[0] or 0
        name = uuid.uuid4().hex if n else None
        if name:
            bits.select("file", "part", "bits").write.parquet(f"{self.path}/deletions/{name}")
        discard(bits)
        return name, n

    def delete(self, where: Column) -> Version:
        """Mark the rows that ``where`` holds for; data files stay as they are."""

        def attempt(now: Version) -> Version:
            name, n = self._bitmaps(self._placed(now).filter(where).select(FILE, PLACE))
            return replace(now, deletions=(*now.deletions, name) if name else now.deletions, counts={"deleted": n})

        return self._change("delete", attempt)

    def upsert(self, rows: DataFrame, key: list[str]) -> Version:
        """Replace all rows that have a key of ``rows``, in one version."""
        name, added = self._write(rows)
        fresh = self.spark.read.schema(self.schema()).parquet(f"{self.path}/data/{name}")
        keys = fresh.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)]).distinct()
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]

        def attempt(now: Version) -> Version:
            gone, n = self._bitmaps(self._placed(now).join(keys, same, "left_semi").select(FILE, PLACE))
            return replace(now, data=(*now.data, name), deletions=(*now.deletions, gone) if gone else now.deletions, counts={"added": added, "deleted": n})

        return self._change("upsert", attempt)

    def compact(self) -> Version:
        """The rows that are left in one new folder, without deletions. Appends that come meanwhile stay as they are."""
        made: dict[tuple, tuple[str, int]] = {}

        def attempt(now: Version) -> Version:
            for (data, deletions), (name, n) in made.items():
                if deletions == now.deletions and set(data) <= set(now.data):
                    return replace(now, data=(name, *[x for x in now.data if x not in set(data)]), deletions=(), counts={"kept": n})
            name, n = self._write(self._placed(now).drop(FILE, PLACE))
            made[now.data, now.deletions] = (name, n)
            return replace(now, data=(name,), deletions=(), counts={"kept": n})

        return self._change("compact", attempt)

    def vacuum(self, keep: int) -> list[str]:
        """Remove the files of all but the ``keep`` newest versions, and the folders that only those name.

        Folders of changes that are under way aren't named yet, so no change may run beside it.
        """
        if keep < 1:
            raise ValueError("at least one version stays")
        known = self.versions()
        old, new = ([self.version(n) for n in part] for part in (known[:-keep], known[-keep:]))
        kept = {f"data/{x}" for v in new for x in v.data} | {f"deletions/{x}" for v in new for x in v.deletions}
        gone = sorted(({f"data/{x}" for v in old for x in v.data} | {f"deletions/{x}" for v in old for x in v.deletions}) - kept)
        for v in old:
            remove(self.spark, self._file(v.number))
        for folder in gone:
            remove(self.spark, f"{self.path}/{folder}")
        return gone
