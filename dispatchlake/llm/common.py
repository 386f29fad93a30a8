"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# one word is a run of characters other than blank, tab, line feed, VT, FF, CR
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# rows and bytes that go to a Python worker at once; texts are much longer than usual columns
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
}


def small_batches(frame: DataFrame) -> None:
    """Bound what Python workers and Arrow hold, unless the session asks for less."""
    conf = frame.sparkSession.conf
    for name, most in BATCH_SETTINGS.items():
        try:
            now = int(conf.get(name).rstrip("b"))
        except (PySparkException, ValueError):  # not known to this version, or with a unit
            continue
        if not 0 < now <= most:
            conf.set(name, str(most))


# what Python workers keep between tasks, by the kind of cache
_caches: dict[str, Callable[[], None]] = {}


def keep_only(kind: str, forget: Callable[[], None]) -> None:
    """Called by an operator whose cache is empty: drop the caches of other kinds.

    Workers live on from stage to stage, so that without this a pipeline's last
    stage would hold the caches of all before it.
    """
    for other, drop in list(_caches.items()):
        if other != kind:
            drop()
            del _caches[other]
    _caches[kind] = forget


def words_of(text: Column) -> Column:
    """Array of words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8: `bytes.split` cuts at exactly these six characters."""
    return text.encode().split() if isinstance(text, str) else []


def slices(frame: pd.DataFrame, column: str, most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Cut a batch so that a slice has about `most` characters, or one longer row."""
    ends = frame[column].str.len().fillna(0).cumsum() // most
    for _, part in frame.groupby(ends.to_numpy(), sort=False):
        yield part


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    if ":/" not in uri:
        uri = f"file://{uri}"
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
