"""Tables written to the folder that the driver and all executors share: they cut lineage, and lost executors lose nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a temporary folder, a cluster session must have one."""
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="rounds-")
    return _folders[app]


class Rounds:
    """Tables of a loop's rounds, or frames that must be read twice alike, as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.read(df, name)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*[f"{self.at}/{n}" for n in names])

    def close(self) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
