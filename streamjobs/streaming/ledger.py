"""A table written by streams in which every batch counts once, also after failures and restarts.

Each batch is written to a folder of its own. It belongs to the table only when its entry in
the ledger is there: a small file named after query and batch, written aside and moved into
place in one step, which names the folder. A batch that is run again (after a failure in the
middle, or after one between the ledger and Spark's own record of the batch) either finds its
entry and does nothing, or writes a new folder; what a failed attempt left is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class BatchLedger:
    """The table below ``path``; any number of queries may write to it, each under its own name."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def _hadoop(self, *parts: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path("/".join([self._path, *parts]))
        return path.getFileSystem(self._spark._jsc.hadoopConfiguration()), path

    def has(self, query: str, batch_id: int) -> bool:
        store, entry = self._hadoop("ledger", query, str(batch_id))
        return store.exists(entry)

    def commit(self, query: str, batch_id: int, folder: str) -> bool:
        """Make a written folder the batch's rows; False if the batch has some already."""
        store, aside = self._hadoop("ledger", query, f".{batch_id}-{uuid.uuid4().hex}")
        out = store.create(aside, False)
        out.write(bytearray(folder.encode()))
        out.close()
        if self.has(query, batch_id):
            return False
        return store.rename(aside, self._hadoop("ledger", query, str(batch_id))[1])

    def write(self, batch: DataFrame, query: str, batch_id: int) -> None:
        """Add a batch, unless it is there."""
        if self.has(query, batch_id):
            return
        folder = f"rows/{query}/{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{self._path}/{folder}")
        self.commit(query, batch_id, folder)

    def writer(self, query: str) -> Callable[[DataFrame, int], None]:
        """The batch handler of a query."""
        return lambda batch, batch_id: self.write(batch, query, batch_id)

    def entries(self) -> list[tuple[str, int, str]]:
        """(query, batch, folder) of all batches."""
        store, top = self._hadoop("ledger")
        found = []
        for query in store.listStatus(top) if store.exists(top) else []:
            for entry in store.listStatus(query.getPath()):
                name = entry.getPath().getName()
                if name.isdigit():
                    source = store.open(entry.getPath())
                    folder = self._spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
                    source.close()
                    found.append((query.getPath().getName(), int(name), folder))
        return sorted(found)

    def rows(self, schema: T.StructType) -> DataFrame:
        """The rows of all batches."""
        return self._read(schema, [folder for *_, folder in self.entries()])

    def last(self, schema: T.StructType, query: str) -> DataFrame:
        """The rows of a query's last batch: the whole result in complete mode."""
        own = [(batch, folder) for name, batch, folder in self.entries() if name == query]
        return self._read(schema, [max(own)[1]] if own else [])

    def _read(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[f"{self._path}/{folder}" for folder in folders])
