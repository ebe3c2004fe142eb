"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_places: list[str] = []


def qualified(spark: SparkSession, place: str) -> str:
    """``place`` with the scheme of its file system, so that Spark and other readers mean the same folder by it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, with its scheme. Only where that is unset, as in tests on one machine, is a temporary folder made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return qualified(spark, root.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="rillbase-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_place(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; nothing is there yet."""
    place = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _places.append(place)
    return place


def places_so_far() -> int:
    """A mark for ``forget``: what is written later is what it may delete."""
    return len(_places)


def forget(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what this process has written to the shared folder since a mark, but for the last ``keep`` places. Results that still read from it must have been used before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    end = len(_places) - keep
    for place in _places[since:end]:
        path = hadoop.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _places[since : max(since, end)]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back."""
    place = shared_place(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
