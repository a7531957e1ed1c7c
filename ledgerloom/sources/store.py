"""The statement store: a table of rows partitioned by statement, and what is known of each statement."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import append_new


class StatementStore:
    """Statements under one folder: ``rows/statement_id=...`` (Parquet) and one small JSON file per statement."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        os.makedirs(f"{path}/meta", exist_ok=True)

    def _meta(self, statement_id: str) -> str:
        return f"{self.path}/meta/{statement_id}.json"

    def _rows(self, statement_id: str) -> str:
        return f"{self.path}/rows/statement_id={statement_id}"

    def _write(self, statement_id: str, rows: DataFrame) -> None:
        to = self._rows(statement_id)
        rows.write.mode("overwrite").parquet(to + ".new")
        shutil.rmtree(to, ignore_errors=True)
        os.replace(to + ".new", to)

    def put(self, statement_id: str, name: str, is_primary: bool, rows: DataFrame) -> None:
        """Import a statement, replacing one of its id."""
        self._write(statement_id, rows)
        with open(self._meta(statement_id), "w") as file:
            json.dump({"statement_id": statement_id, "name": name, "is_primary": is_primary}, file)

    def list(self) -> list[dict]:
        return [json.load(open(f"{self.path}/meta/{n}")) for n in sorted(os.listdir(f"{self.path}/meta"))]

    def get(self, statement_id: str) -> DataFrame:
        return self.spark.read.parquet(self._rows(statement_id)).withColumn("statement_id", F.lit(statement_id))

    def pool(self, primary: bool) -> DataFrame | None:
        """All rows of the primary or of the other statements; partitions of the rest aren't read."""
        ids = [m["statement_id"] for m in self.list() if m["is_primary"] == primary]
        return self.spark.read.option("basePath", f"{self.path}/rows").option("mergeSchema", True).parquet(*map(self._rows, ids)) if ids else None

    def update(self, statement_id: str, **changes) -> None:
        """Rename a statement or make it primary."""
        meta = json.load(open(self._meta(statement_id))) | changes
        with open(self._meta(statement_id), "w") as file:
            json.dump(meta, file)

    def append(self, statement_id: str, batch: DataFrame, key: str = "content_hash") -> None:
        """Add the rows of a batch that aren't stored yet."""
        self._write(statement_id, append_new(self.spark.read.parquet(self._rows(statement_id)), batch, key))

    def replace_rows(self, statement_id: str, changed: DataFrame, key: str) -> None:
        """Put changed rows in the place of those with their keys."""
        old = self.spark.read.parquet(self._rows(statement_id))
        self._write(statement_id, old.join(changed.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(changed, allowMissingColumns=True))

    def drop_columns(self, statement_id: str, *columns: str) -> None:
        self._write(statement_id, self.spark.read.parquet(self._rows(statement_id)).drop(*columns))

    def delete(self, statement_id: str) -> None:
        shutil.rmtree(self._rows(statement_id), ignore_errors=True)
        if os.path.exists(self._meta(statement_id)):
            os.remove(self._meta(statement_id))

    def clear(self) -> None:
        for m in self.list():
            self.delete(m["statement_id"])
