"""Tables in the shared checkpoint folder that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def finished_shuffles_deleted(spark: SparkSession):
    """Queries that are built within have their shuffle files deleted when they end, not whenever the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Parquet tables in the shared checkpoint folder; they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        sc = spark.sparkContext
        base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="driftwell-"))  # one machine only, such as tests
            base = sc.getCheckpointDir()
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)  # results read these tables until the session ends

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Removes all tables; what was computed from them and not yet written can no longer be read."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # at exit the JVM may be gone
            self._delete(self.path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
