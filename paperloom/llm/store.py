"""Shared storage for tables that cut lineage, and shipping of this package to the workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a single-process session (tests) gets a
    temporary one; on a cluster that is an error, as its executors share no such folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("paperloom.shared.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("paperloom.shared.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    _live.setdefault(id(spark), (spark, []))[1].append(path)
    return path


_live: dict[int, tuple[SparkSession, list[str]]] = {}


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, paths in _live.values():
        for path in paths:
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
                return


atexit.register(_clean)


def written(df: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """df as a Parquet table in the shared folder: it survives lost executors and cuts the lineage."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame, spark: SparkSession) -> None:
    """Deletes a table of written() that no pending result reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(spark, f)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once a session."""
    if spark.conf.get("paperloom.shipped", "") == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parents[2]
    at = Path(tempfile.mkdtemp(prefix="paperloom-zip-")) / "paperloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in (root / "paperloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    spark.conf.set("paperloom.shipped", spark.sparkContext.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sampled(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """About n of df's total rows, those with the lowest hashes of key; 2 n at most. Nothing is sorted or gathered for it."""
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30))
    return df.filter(part < int((1 << 30) * min(1.0, n / max(1, total)))).limit(2 * n)
