"""Tables written once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class BatchTable:
    """A parquet table with one folder per micro-batch.

    Writing a batch replaces its folder, so a replayed batch leaves no duplicates; readers take the
    folders Spark marked complete. A table of reduced rows (latest value, last points, latest step) is
    kept small by :meth:`compact`, which folds the batches so far into a base. Jobs that write one table
    number their batches on their own, so each names itself as the ``source`` of its folders.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path, partition_by
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def of_source(self, source: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.path}/sources/source={source}", self.schema, self.partition_by)

    def _parts(self) -> list[BatchTable]:
        """This table's own batches and those of each source."""
        return [self, *(self.of_source(name) for name in sorted(self._folders("sources/source=*")))]

    def write(self, batch_id: int, rows: DataFrame, source: str | None = None) -> None:
        if source:
            self.of_source(source).write(batch_id, rows)
            return
        (rows.select(*self.schema.fieldNames()).write.mode("overwrite")
         .partitionBy(*self.partition_by).parquet(f"{self.path}/batches/batch_id={batch_id}"))

    def _folders(self, pattern: str) -> dict[str, str]:
        """Value behind the last = of each folder of the pattern, and the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        folders = [status.getPath() for status in found]
        folders = [f.getParent() if f.getName() == "_SUCCESS" else f for f in folders]
        return {folder.getName().split("=")[1]: folder.toString() for folder in folders}

    def _complete(self, kind: str) -> dict[int, str]:
        return {int(n): folder for n, folder in self._folders(f"{kind}=*/_SUCCESS").items()}

    def _newest(self, before: int | None = None) -> tuple[list[str], str | None, int | None]:
        """Folders of the batches after the newest base (and below ``before``), that base, and the last batch."""
        bases = {n: p for n, p in self._complete("base/upto").items() if before is None or n < before}
        upto = max(bases, default=None)
        batches = {n: p for n, p in self._complete("batches/batch_id").items()
                   if (upto is None or n > upto) and (before is None or n < before)}
        return [batches[n] for n in sorted(batches)], bases.get(upto), max(batches, default=None)

    def batch(self, batch_id: int) -> DataFrame:
        """The rows one batch wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batches/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All complete rows, or those of the batches below ``before``; an empty table before the first batch."""
        whole = [part._rows(part._newest(before)) for part in self._parts()]
        return reduce(DataFrame.unionByName, whole)

    def _rows(self, newest: tuple[list[str], str | None, int | None]) -> DataFrame:
        batches, base, _ = newest
        columns = self.schema.fieldNames()
        parts = []
        if batches:
            parts.append(self.spark.read.schema(self.schema).option("basePath", f"{self.path}/batches")
                         .parquet(*batches).select(*columns))
        if base:
            parts.append(self.spark.read.schema(self.schema).parquet(base))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Fold everything complete into a new base. ``fold`` must give the same result over partial results.

        The folders are listed once: a batch that completes meanwhile is left for the next time.
        """
        for part in self._parts():
            newest = part._newest()
            if newest[2] is not None:
                (fold(part._rows(newest)).select(*self.schema.fieldNames())
                 .write.mode("overwrite").parquet(f"{part.path}/base/upto={newest[2]}"))
