"""Tables that change as a whole: snapshots published by one pointer after a gate, and rows replaced by key, bucket by bucket."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.plans import report
from specloom.session import settled

#: Buckets of a keyed table: the pointer names one folder for each, so their number bounds it.
BUCKETS = 64


class Regression(RuntimeError):
    """A run that the gate did not let through; ``problems`` says why."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("not published: " + "; ".join(problems))
        self.problems = list(problems)


class Pointers:
    """Numbered files in a folder, of which the last counts. Each is written aside and renamed, which fails if its number is taken:
    readers see a whole pointer or the one before, and of two writers one fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, dict | None]:
        """(number, content) of the pointer that counts; (0, None) if there is none."""
        folder = self._path(f"{self.root}/pointers")
        if not self._files.exists(folder):
            return 0, None
        numbers = [int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit()]
        if not numbers:
            return 0, None
        stream = self._files.open(self._path(f"{self.root}/pointers/{max(numbers):012d}"))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def set(self, content: dict, after: int) -> None:
        """Makes ``content`` the pointer that follows number ``after``; fails if another has taken its place."""
        aside, place = self._path(f"{self.root}/pointers/_{uuid.uuid4().hex}"), self._path(f"{self.root}/pointers/{after + 1:012d}")
        stream = self._files.create(aside, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode("utf-8")))
        stream.close()
        if self._files.exists(place) or not self._files.rename(aside, place):
            self._files.delete(aside, False)
            raise RuntimeError(f"another run has published number {after + 1}")


class Snapshots:
    """Sets of tables under ``root``, of which one is published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.pointers = spark, Pointers(spark, root)

    def published(self) -> dict[str, DataFrame]:
        """The tables of the published snapshot by name; none before the first."""
        _, told = self.pointers.last()
        return {n: self.spark.read.parquet(p) for n, p in (told or {}).items()}

    def publish(self, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], totals: Mapping[str, Callable[[DataFrame], int]] | None = None, check: Callable | None = None) -> dict[str, DataFrame]:
        """Writes ``tables`` aside, holds them against the published ones and publishes them together; returns them as read back.

        No table may lose keys (columns by table's name; a table without counts for nothing), none of ``totals`` (a number of a
        table, by its name) may fall, and ``check(before, after)`` may name other problems. Else ``Regression`` is raised and what was
        published stays. A table that is no longer given counts as lost. What a run that ended early has written is never read.
        """
        number, told = self.pointers.last()
        paths = {n: f"{self.pointers.root}/data/{uuid.uuid4().hex}/{n}" for n in tables}
        for name, df in tables.items():
            df.write.parquet(paths[name])
        after = {n: self.spark.read.parquet(p) for n, p in paths.items()}
        if told is not None:
            before = {n: self.spark.read.parquet(p) for n, p in told.items()}
            problems = [f"{n}: no longer there" for n in before if n not in after]
            both = {n: before[n] for n in before if n in after and n in keys}
            numbers = {n: (f(before[n]), f(after[n])) for n, f in (totals or {}).items() if n in before and n in after}
            problems += report.gate(both, after, dict(keys), numbers)
            problems += list(check(before, after)) if check else []
            if problems:
                raise Regression(problems)
        self.pointers.set(paths, number)
        return after


class KeyedTable:
    """Rows with one row a key, in buckets by the key's hash; a change rewrites the buckets of its keys only.

    The pointer names each bucket's folder. Readers of the pointer before go on reading its folders, which stay as they are.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets, self.pointers = spark, key, buckets, Pointers(spark, root)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _told(self) -> tuple[int, dict[str, str]]:
        number, told = self.pointers.last()
        if told is not None and told["buckets"] != self.buckets:
            raise ValueError(f"the table has {told['buckets']} buckets")
        return number, dict(told["folders"]) if told else {}

    def _read(self, folders: Mapping[str, str], which: Sequence[str] | None = None) -> DataFrame | None:
        paths = sorted(f"{p}/_bucket={b}" for b, p in folders.items() if which is None or b in which)
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """All rows; null before the first change."""
        return self._read(self._told()[1])

    def put(self, rows: DataFrame, force: bool = False) -> int:
        """Adds the ``rows`` whose key is new, and with ``force`` puts the others in place of those there are; how many it was.

        Rows that say what is there already change nothing, so a second run writes nothing. Columns must be those of the
        table. A key that is null or comes twice in ``rows`` is an error, whatever else happens.
        """
        number, folders = self._told()
        rows = rows.withColumn("_bucket", self._bucket())
        again = rows.groupBy(self.key).count().where((F.col("count") > 1) | F.col(self.key).isNull()).limit(5).collect()
        if again:
            raise ValueError(f"not one row a key: {[r[0] for r in again]}")
        now = self._read(folders)
        if now is not None:
            names = [c for c in rows.columns if c != "_bucket"]
            if set(names) != set(now.columns):
                raise ValueError(f"columns are {sorted(names)}, the table has {sorted(now.columns)}")
            said = F.struct(*[F.col(c) for c in sorted(names)])
            old = now.select(F.col(self.key).alias("_k"), F.to_json(said, {"ignoreNullFields": "false"}).alias("_said"))
            both = rows.join(old, F.col(self.key) == F.col("_k"), "left")
            other = F.col("_k").isNull() | (F.lit(force) & (F.col("_said") != F.to_json(said, {"ignoreNullFields": "false"})))
            rows = both.where(other).select(*names, "_bucket")
        changed = settled(rows)
        touched = {str(r["_bucket"]): r["count"] for r in changed.groupBy("_bucket").count().collect()}  # a row a bucket
        if not touched:
            return 0
        kept, path = self._read(folders, list(touched)), f"{self.pointers.root}/data/{uuid.uuid4().hex}"
        if kept is not None:
            kept = kept.join(changed.select(self.key), self.key, "left_anti")
            changed = changed.unionByName(kept.withColumn("_bucket", self._bucket()))
        changed.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        self.pointers.set({"buckets": self.buckets, "folders": folders | dict.fromkeys(touched, path)}, number)
        return sum(touched.values())
