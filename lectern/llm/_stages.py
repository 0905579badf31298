"""Tables that cut a long lineage: written once to the shared folder, then read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lectern.llm

# Functions sent to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(lectern.llm)

_CLEAN, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULTS = {_CLEAN: "false", _BATCH: "10000"}
#: Small Arrow batches keep long texts and shingle sets from filling a Python worker.
_WHILE_WRITING = {_CLEAN: "true", _BATCH: "2000"}
_roots: dict[str, tuple[SparkSession, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that setting is missing, a local master gets a temporary folder; a
    cluster must name a shared one.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        elif not base.split("/", 1)[0].endswith(":"):
            base = "file://" + base if spark.sparkContext.master.startswith("local") else base
        _roots[app] = (spark, f"{base}/lectern-{app}")
        atexit.register(_remove_root, app)
    return _roots[app][1]


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_root(app: str) -> None:
    spark, path = _roots.pop(app)
    with contextlib.suppress(Exception):  # the session may be gone at exit
        _remove(spark, path)


def arrow_map(source: DataFrame, run, results: dict[str, str], hidden: tuple[str, ...]) -> DataFrame:
    """source.mapInArrow(run) with the columns of `source` but the hidden ones, then those in `results` (name: type).

    Columns that pass through travel under plain names: mapInArrow resolves
    names and would take a dot in one for a field.
    """
    names = [c for c in source.columns if c not in hidden]
    plain = [c if c in hidden else f"__c{k}" for k, c in enumerate(source.columns)]
    renamed = source.toDF(*plain)
    schema = ", ".join([f"{n} {t}" for n, t in renamed.dtypes if n not in hidden] + [f"{n} {t}" for n, t in results.items()])
    return renamed.mapInArrow(run, schema).toDF(*names, *results)


class Stages:
    """Writes intermediate results of one operator call and drops those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Parquet survives lost executors; the shuffle files of the run that wrote it may go."""
        path = f"{self.root}/{name}"
        before = {k: self.spark.conf.get(k, v) for k, v in _DEFAULTS.items()}
        for k, v in _WHILE_WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def grouped_batches(batches, keys: list[str], rows: int = 20_000, size: int = 16 << 20):
    """Cut a stream of batches sorted by `keys` into tables of whole groups.

    A table closes at the first group border after `rows` rows or `size` bytes;
    what is held is bounded by that plus one group.
    """
    held: list[pa.Table] = []
    count = nbytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and count >= rows or nbytes >= size:
            cut = _border(held[-1], table, keys)
            if cut is not None:
                if cut:
                    held.append(table.slice(0, cut))
                yield pa.concat_tables(held).combine_chunks()
                table = table.slice(cut)
                held, count, nbytes = [], 0, 0
        held.append(table)
        count += table.num_rows
        nbytes += table.nbytes
    if held and count:
        yield pa.concat_tables(held).combine_chunks()


def _border(before: pa.Table, table: pa.Table, keys: list[str]) -> int | None:
    """The first row of `table` that starts another group than the last row of `before`."""
    last = tuple(before[k][before.num_rows - 1].as_py() for k in keys)
    columns = [table[k].to_pylist() for k in keys]
    for i in range(table.num_rows):
        if tuple(c[i] for c in columns) != last:
            return i
    return None
