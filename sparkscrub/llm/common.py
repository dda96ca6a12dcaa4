"""What the operators of this subpackage share: reading tables, Arrow batches, shared tables."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkscrub.session import written_table

#: A word is a run of anything but a space, tab, line feed, vertical tab, form feed or carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage cut, nothing computed twice."""
    return written_table(df, f"llm-{label}")


def discard(table: DataFrame) -> None:
    """Delete a table that ``shared`` wrote and that nothing reads any more."""
    for folder in {posixpath.dirname(f) for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Whole documents are long: so many at once are held as Python strings.
SLICE_ROWS = 256


def texts_of(column: pa.Array, rows: int = SLICE_ROWS) -> Iterator[str | None]:
    """The texts of an Arrow column, a few at a time as Python strings."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def arrow_map(df: DataFrame, schema: str | StructType, fn: Callable[..., dict[str, list]]) -> DataFrame:
    """``fn`` over the rows of ``df``, some hundred at a time: columns in as Python lists, columns out by name."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(shape)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                got = fn(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])
                yield pa.RecordBatch.from_pydict({f.name: pa.array(got[f.name], type=f.type) for f in out}, schema=out)

    return df.mapInArrow(run, shape)


def random_key(seed: int, *columns: Column) -> Column:
    """A uniform 64-bit key that depends on ``seed`` and the columns only."""
    return F.xxhash64(F.lit(seed), *columns)


def unscaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: no digit changes, no norm overflows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def cosines(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosine of one vector to rows in double precision, the same number for the same two vectors wherever it is computed."""
    q, m = unscaled(q[None])[0], unscaled(m)
    return (m * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((m * m).sum(axis=1)))
