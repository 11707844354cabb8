"""What the operators of this subpackage share: table access and row-wise Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python operator turns into objects at once; Spark bounds the Arrow batch in bytes.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a folder of this machine serves a local session (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="cinderloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, for what the result itself is read from; Spark's cleaner removes it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables in the shared folder between the steps of one operator: ``put`` writes one, ``drop`` removes them once spent.

    As Parquet they are smaller than checkpoints, only the columns that a step uses are read, and a lost executor
    costs no recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.written: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.written)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    @contextlib.contextmanager
    def until_later(self):
        """What is put inside goes at the end, and so do the frames given besides; ``later(df, *spent)`` puts one that stays."""
        began, stays, spent = len(self.written), [], []

        def later(df: DataFrame, *done: DataFrame) -> DataFrame:
            stays.append(self.put(df))
            spent.extend(done)
            return stays[-1]

        yield later
        made = [df for df, _ in self.written[began:] if not any(df is x for x in stays)]
        self.drop(*made, *spent) if made or spent else None

    def drop(self, *tables: DataFrame) -> None:
        """Removes these, or all without arguments."""
        jvm = self.spark.sparkContext._jvm
        for path in [path for df, path in self.written if any(df is x for x in tables)] if tables else [self.top]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sieve(rows: DataFrame, col: str, keys: DataFrame, key: str, bits: int = 1 << 23) -> DataFrame:
    """The rows whose ``col`` (a long) may be among the keys, without a shuffle of them: a bitmap of fixed size, as words of 64 bits, is broadcast.

    However many keys there are, it has at most ``bits`` / 64 rows; the more there are, the more rows pass that have none.
    """
    slot = lambda c: F.pmod(F.col(c), F.lit(bits))
    bit = lambda c: F.pmod(slot(c), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))
    words = keys.groupBy(F.floor(slot(key) / 64).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    there = F.call_function("shiftright", F.col("__bits"), bit(col)).bitwiseAND(F.lit(1).cast("long")) != 0
    return rows.join(F.broadcast(words), F.floor(slot(col) / 64) == F.col("__word")).where(there).drop("__word", "__bits")


def give_back() -> None:
    """Returns a worker's free memory at a task's end: workers serve many tasks, and executors hold several of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: T.StructType, many: bool = False) -> DataFrame:
    """Maps rows with the function that ``make()`` gives in the worker, in slices of bounded size.

    The function gets a row's values and returns a tuple, or a list of tuples with ``many``.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        row = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                found = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if many:
                    found = [x for xs in found for x in xs]
                cols = list(zip(*found, strict=True)) if found else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
        row = found = cols = None
        give_back()

    return df.mapInArrow(run, schema)


def map_cells(rows: DataFrame, cell: list[str], order: str, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``fn`` of each cell's rows, a pandas frame sorted by ``order``; it gives tuples. Cells must be of bounded size.

    Cells are dealt out by hash and sorted, and a task goes through its cells one after another.
    """
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def batch(found: Iterable[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches):
        held, key = [], None
        for b in batches:
            p = b.to_pandas()
            if not len(p):
                continue
            marks = pd.MultiIndex.from_frame(p[cell])
            edges = [0, *(i for i in range(1, len(p)) if marks[i] != marks[i - 1]), len(p)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and marks[lo] != key:
                    yield batch(fn(pd.concat(held, ignore_index=True)))
                    held = []
                key = marks[lo]
                held.append(p.iloc[lo:hi])
        if held:
            yield batch(fn(pd.concat(held, ignore_index=True)))
        held = None
        give_back()

    return rows.repartition(*cell).sortWithinPartitions(*cell, order).mapInArrow(run, kind)


class Memo(dict):
    """A bounded memo in two generations: what was used since the last turn survives the next one. Long keys are not kept."""

    LONGEST = 64

    def __init__(self, make: Callable, size: int = 250_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > self.LONGEST:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
