"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.session import shared_dir

WHITE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    Cuts the lineage like a checkpoint, survives lost executors and is compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are stored and no longer referred to.

    Spark deletes them when the driver's collector finds their plans unused, which may
    take long; two collections with a pause find plans that others referred to.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While the block runs, Python tasks get no more than ``most`` rows at a time: texts and sets are wide.

    Buffers of a batch stand in the executor and in its Python worker, and neither gives them back soon.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frame(rows: list, columns: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects: Arrow then makes one array of each column, strings too."""
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, zip(*rows) if rows else [[]] * len(columns))})


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def fold(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered (no other letter changes); null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def spans(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and each word's start and end in it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links that connect the same values as the links ``a[i] - b[i]``: (value, least of its group)."""
    values, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    flat = flat.ravel()
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    other = np.flatnonzero(label != np.arange(len(values)))
    return values[other], values[label[other]]
