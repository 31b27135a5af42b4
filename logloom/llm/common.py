"""What the operators share: column handling, written tables, checked broadcasts, numpy hashing.

Columns are taken by name and renamed to names of the operator's own, so that
other columns of the input, whatever they are called, neither clash nor travel.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]

#: Rows up to which a small table (a few numbers a row) may be broadcast.
BROADCAST_ROWS = 200_000


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``pick(docs, doc="doc_id")``."""
    return df.select(*(col(name).alias(alias) for alias, name in columns.items()))


def rest(df: DataFrame, taken: list[str]) -> list[str]:
    """The columns of ``df`` that do not clash with the operator's own result columns."""
    own = {name.lower() for name in taken}
    return [name for name in df.columns if name.lower() not in own]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, no lineage, survives executors.

    Compressed with zstd, whose buffers live on the heap; those of snappy are native memory beside it.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where the counted ``rows`` are within the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def lowest(df: DataFrame, key: Column, rows: int, n: int) -> DataFrame:
    """Of a table of so many ``rows``, those among which are the ``n`` with the smallest ``key``, a 64-bit hash.

    They are hardly more than ``n``, so that taking the first ``n`` in order does not send ``n`` rows of every task to the driver.
    """
    share = (1.2 * n + 100) / max(rows, 1)
    return df if share >= 1 else df.where(key < F.lit(int(share * 2**64) - 2**63))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
