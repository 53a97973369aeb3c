"""Small helpers the operators share."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.session import scratch_path, without_shuffles
from casemill.sources import files

_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later jobs see one fixed result, whoever is lost.

    What the write has shuffled is removed behind it, so that disk holds one job's shuffles and not all of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """Hold the batches that tasks hand to Python to ``BATCH_BYTES`` each; by Spark's default ten thousand texts go at once.

    Every batch stands in the JVM and in Python. A size set by the caller stays.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def discard(df: DataFrame) -> None:
    """Remove the folders of a settled frame that nothing reads any more; what was made from it is settled itself."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        files.delete(df.sparkSession, folder)


def free_name(df: DataFrame, base: str) -> str:
    """A column name the frame does not have."""
    taken = {c.lower() for c in df.columns}
    return base if base.lower() not in taken else f"{base}_{uuid.uuid4().hex[:8]}"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(column: pa.Array, most_bytes: int):
    """Row ranges of a string column with about ``most_bytes`` each; one longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield at, to
        at = to


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``pool[starts[i] : starts[i] + lengths[i]]``."""
    total = int(lengths.sum())
    shift = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - shift, lengths) + np.arange(total)]


# Schemes of Spark's paths, and what the file systems of tasks call them.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def shared_folder(spark: SparkSession, path: str) -> str:
    """The address under which tasks open what Spark knows as ``path``; to be asked on the driver.

    A path without scheme lies on the default file system, as it does for Spark. A scheme that tasks cannot open raises
    ValueError before anything is written. Tasks find the credentials of a store where pyarrow looks for them.
    """
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    if not found:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    scheme = found[1].lower()
    if scheme not in _SCHEMES:
        raise ValueError(f"tasks cannot open {scheme}: paths; choose one of {', '.join(sorted(_SCHEMES))} for {path}")
    return _SCHEMES[scheme] + path[len(scheme) :]


def store_of(path: str):
    """The file system of an address from ``shared_folder`` and the path within it, for reads and writes of tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} names no file system")
    return fs.FileSystem.from_uri(path)
