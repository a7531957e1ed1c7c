"""Keyed state that operators keep between batches.

A state is a folder of logs and a manifest. A log is an append-only table in bucket files by its key: a batch that looks
its keys up is shuffled to the buckets alone, the rows stored before stay where they are and are read once, as a stream.
The manifest says which turns began and which were taken in whole; rows of a turn that broke off are never read. All of
it is found again from the folder, so a new process goes on where the last one stopped, and a second writer is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log: (its columns as DDL, the columns of its key)
Layout = dict[str, tuple[str, list[str]]]


class State:
    """Logs under ``path``, each row with the number of the turn that wrote it (``turn``).

    ``buckets`` (default: the session's shuffle partitions) counts for a new folder only; a stored one keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, layout: Layout, buckets: int | None = None):
        self.spark, self.path, self.layout, self.now = spark, path.rstrip("/"), layout, None
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.path}/layout.json")):
            self._write("layout.json", {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))})
        self.buckets = self._read("layout.json")["buckets"]
        where = format(hash_of(self.path), "016x")
        self._names = {log: f"ledgerloom_{log}_{where}" for log in layout}
        for log, (columns, keys) in layout.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._names[log]} ({columns}, turn INT) USING parquet CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{log}'")
            spark.catalog.refreshTable(self._names[log])

    def _write(self, name: str, content: dict) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _read(self, name: str) -> dict:
        file = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _turns(self, kind: str) -> set[int]:
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return {int(name.split(".")[0][5:]) for name in found if name.startswith("turn-") and name.endswith("." + kind)}

    def taken(self) -> dict[int, dict]:
        """The turns taken in, with the notes they left."""
        return {k: self._read(f"turn-{k}.done") for k in sorted(self._turns("done"))}

    @contextmanager
    def turn(self) -> Iterator[dict]:
        """Takes in one batch: what is appended inside counts if the block ends well. Yields the note it leaves."""
        begun = self._turns("begun")
        number = max(begun, default=0) + 1
        self._write(f"turn-{number}.begun", {})
        self.now, note = number, {}
        try:
            yield note
            self._write(f"turn-{number}.done", note)
        finally:
            self.now = None

    def append(self, **rows: DataFrame) -> None:
        """Adds rows to logs, named by the logs; only inside a turn. Several logs are written side by side."""
        if self.now is None:
            raise ValueError("rows are appended inside a turn only")

        def write(log: str) -> None:
            columns, keys = [c for c in self.spark.table(self._names[log]).columns if c != "turn"], self.layout[log][1]
            rows[log].select(*columns, F.lit(self.now).alias("turn")).repartition(self.buckets, *keys).write.insertInto(self._names[log])

        with ThreadPoolExecutor(len(rows)) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), rows))

    def log(self, name: str) -> DataFrame:
        """The rows of a log: of the turns taken in, and of the one that is open."""
        broken = self._turns("begun") - self._turns("done") - {self.now}
        rows = self.spark.table(self._names[name])
        return rows.where(~F.col("turn").isin(sorted(broken))) if broken else rows

    def drop(self) -> None:
        """Deletes the folder and all that is known of it."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._fs.delete(self._path(self.path), True)


def deal(rows: DataFrame, folder: str, of: str = "of") -> DataFrame:
    """The rows, written once to a folder by their turn ``of``, so that a turn reads only its own."""
    rows.write.partitionBy(of).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def hash_of(text: str) -> int:
    """A number for a text that is the same in every process."""
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
