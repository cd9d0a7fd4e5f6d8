"""Document tables with an id: every write adds or replaces rows by id, and the last write of an id counts.

A write is a folder of its own, named by its number and replaced as a whole if it is repeated, so that a micro-batch that runs twice
has no effect the second time. Every so many writes are folded into one base, so that reading costs the table's size and a few
writes, however long its history is. A base is in force once it is whole; what it replaces is deleted after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Writes between two folds.
FOLD = 16


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, order: str | None = None, fold: int = FOLD):
        self.spark, self.path, self.key, self.order, self.fold_every = spark, path.rstrip("/"), key, order, fold

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, kind: str) -> list[int]:
        """The whole folders of a kind, write or base, in order."""
        system, at = self._fs(self.path)
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()]
        found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))
        return [n for n in found if system.exists(self._fs(f"{self.path}/{kind}={n}/_SUCCESS")[1])]

    def _newest(self, df: DataFrame, order: list) -> DataFrame:
        ranked = Window.partitionBy(self.key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")

    def create(self, schema: str, overwrite: bool = False) -> None:
        """An empty table of the schema; one that is there is an error or replaced."""
        system, at = self._fs(self.path)
        if system.exists(at):
            if not overwrite:
                raise ValueError(f"{self.path} exists")
            self.drop()
        self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/write=-1")

    def drop(self) -> None:
        system, at = self._fs(self.path)
        system.delete(at, True)

    def exists(self, before: int | None = None) -> bool:
        return any(before is None or n < before for n in self._numbers("write") + self._numbers("base"))

    def upsert(self, df: DataFrame, number: int) -> None:
        """Rows of one write; of several rows of an id the one that is last by order counts."""
        rows = self._newest(df, [self.order]) if self.order else df.dropDuplicates([self.key])
        rows.write.mode("overwrite").parquet(f"{self.path}/write={number}")
        if len(self._numbers("write")) >= self.fold_every:
            self._fold(number)

    def _fold(self, number: int) -> None:
        """All before this write becomes one base; the write itself stays, as it may be repeated."""
        if number - 1 not in self._numbers("base"):
            self.rows(before=number).withColumnRenamed("write", "written").write.mode("overwrite").parquet(f"{self.path}/base={number - 1}")
        for kind, limit in (("write", number - 1), ("base", number - 2)):
            for n in self._numbers(kind):
                if n <= limit:
                    system, at = self._fs(f"{self.path}/{kind}={n}")
                    system.delete(at, True)

    def replace(self, df: DataFrame, number: int) -> None:
        """df, whose ids are distinct, as the whole table: rows of earlier writes don't count any more. The base before stays, for a batch that runs again."""
        df.withColumn("written", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/base={number}")
        for kind, limit in (("write", number), ("base", number - 2)):
            for n in self._numbers(kind):
                if n <= limit:
                    system, at = self._fs(f"{self.path}/{kind}={n}")
                    system.delete(at, True)

    def sink(self):
        """For writeStream.foreachBatch."""
        return lambda df, batch: self.upsert(df, batch)

    def rows(self, before: int | None = None) -> DataFrame:
        """The newest row of each id, with the number of its write; before: as it was before that write, where its base is still there."""
        bases = [n for n in self._numbers("base") if before is None or n < before]
        parts = [self.spark.read.parquet(f"{self.path}/base={bases[-1]}").withColumnRenamed("written", "write")] if bases else []
        parts += [self.spark.read.parquet(f"{self.path}/write={n}").withColumn("write", F.lit(n)) for n in self._numbers("write") if (not bases or n > bases[-1]) and (before is None or n < before)]
        if not parts:
            raise ValueError(f"there is no table {self.path}")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        return self._newest(whole, ["write"])

    def read(self) -> DataFrame:
        return self.rows().drop("write")

    def compact(self, path: str) -> "KeyedTable":
        """The table as one write in another folder."""
        new = KeyedTable(self.spark, path, self.key, self.order, self.fold_every)
        self.read().write.mode("overwrite").parquet(f"{new.path}/write=0")
        return new
