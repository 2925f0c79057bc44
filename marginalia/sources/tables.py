"""Tables in the folder that a cluster shares, which cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is unset and Spark runs in one process (as in tests) a temporary folder serves instead.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Tables:
    """Tables that cut lineage: written as Parquet to the shared folder and read again, so that they outlive executors.

    Reading packs small files together, so that a small table is few tasks. A table goes with `drop` once nothing reads
    it; what results still read goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder, self._made = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        self._remove = lambda name: path(name).getFileSystem(conf).delete(path(name), True)
        atexit.register(self._forget)

    def keep(self, df: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self._folder}/{self._made}"
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(self._paths.pop(id(t))[1])

    def _forget(self) -> None:
        with contextlib.suppress(Exception):  # the application may be gone
            self._remove(self._folder)
