"""Scalars of a training run, written by the run itself under its name and steps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "step bigint, name string, value double"
LOG_SCHEMA = f"run string, block bigint, {SCHEMA}"
#: Steps that are written at a time, as one file.
EVERY = 100


@dataclass
class StepLog:
    """Appends scalars of steps to ``path``; a step that is run again replaces its rows and those after it in its block.

    A block of ``every`` steps is one folder, overwritten as a whole, so a retried or restarted run leaves no row twice.
    The values come from the step's own job; logging adds no scan.
    """

    spark: SparkSession
    path: str
    run: str
    every: int = EVERY
    block: int | None = None
    rows: list[tuple[int, str, float]] = field(default_factory=list)

    def _folder(self, block: int) -> str:
        return f"{self.path.rstrip('/')}/run={self.run}/block={block}"

    def add(self, step: int, **scalars: float) -> None:
        block = step // self.every
        if block != self.block:
            self.flush()
            self.block = block
            if step % self.every:  # a run that goes on in the middle of a block keeps what was before
                found = _read(self.spark, self.path)
                if found is not None:
                    same = found.where((F.col("run") == self.run) & (F.col("block") == block) & (F.col("step") < step))
                    self.rows = [tuple(r) for r in same.select("step", "name", "value").collect()]
        self.rows = [r for r in self.rows if r[0] < step]
        self.rows += [(step, name, float(value)) for name, value in scalars.items()]

    def flush(self) -> None:
        """Write the open block."""
        if self.block is not None and self.rows:
            frame = self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1)
            frame.write.mode("overwrite").parquet(self._folder(self.block))
        self.block, self.rows = None, []


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def read_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Rows ``(run, step, name, value)`` of all runs or one."""
    found = _read(spark, path)
    if found is None:
        found = spark.createDataFrame([], LOG_SCHEMA)
    return (found if run is None else found.where(F.col("run") == run)).select("run", "step", "name", "value")
