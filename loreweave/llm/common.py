"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Characters between words, as in ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a class of a Java regular expression.
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text that a worker handles and sends back at a time; a longer text is a piece of its own.
PIECE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loreweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: The folders that ``stored`` has written in this process, in order.
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loreweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def n_stored() -> int:
    """How many folders have been written; a mark for ``discard``."""
    return len(_written)


def discard(spark: SparkSession, since: int) -> None:
    """Remove the folders written after the mark but for the newest, for when that holds all that is still needed."""
    for path in _written[since:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[since:-1]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(batch: pa.RecordBatch, text_col: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that the texts of a piece but for its last begin within ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(starts[1:] != starts[:-1]) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        yield batch.slice(at, end - at)


def map_texts(
    df: DataFrame,
    fn: Callable[[list[str]], list[pa.Array]],
    fields: str,
    text_col: str = "text",
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add the columns of ``fields`` that ``fn`` makes of a batch of texts.

    A null text counts as the empty text.  A column of ``df`` named like one of
    ``fields`` gives way to the new one; the columns in ``drop`` do not come back
    from the workers.
    """
    added = T._parse_datatype_string(fields)
    new = [f.name for f in added]
    kept = [f for f in df.schema if f.name not in new and f.name not in drop]
    out = T.StructType([*kept, *added])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                texts = [t if t is not None else "" for t in piece.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *fn(texts)], names=[*names, *new])

    columns = list(dict.fromkeys([*names, text_col]))
    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(run, out)
