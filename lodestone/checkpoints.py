"""Tables that cut lineage: written to the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset on
a local master (tests, notebooks) a folder is made and set; elsewhere it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set if there is none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


#: Rows of a task: a task's sorts and tables of groups stay small whatever the input.
ROWS = 1 << 20


def pieces(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of rows: the session's, or more where a task would get more than ``ROWS``."""
    return max(int(spark.conf.get(_PARTS)), -(-int(rows or 0) // ROWS))


_PARTS = "spark.sql.shuffle.partitions"
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one computation; ``drop`` removes those no longer read.

    sweep: the shuffle files of a table's query are removed once the table is written
    (else they stay until the driver collects garbage); nothing reads them again, as
    the table cuts the lineage."""

    def __init__(self, spark: SparkSession, label: str, sweep: bool = False):
        self.spark = spark
        self.sweep = sweep
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._made = 0

    def table(self, df: DataFrame, name: str = "t", parts: int | None = None) -> DataFrame:
        """Write df and return a reader of what was written.  parts: partitions of the shuffles on the way."""
        self._made += 1
        path = f"{self.root}/{self._made}-{name}"
        held = {_SWEEP: ("true" if self.sweep else None, "false"), _PARTS: (parts and str(parts), "200")}
        was = {k: self.spark.conf.get(k, default) for k, (new, default) in held.items() if new}
        try:
            for k in was:
                self.spark.conf.set(k, held[k][0])
            df.write.parquet(path)
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_lodestone_path", None):
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
