"""What the operators share about the session: partition counts and checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Rows of an Arrow batch: texts are long, and a task holds a few batches at once.
BATCH_ROWS = 1000


def partitions(spark: SparkSession, times: int = 1) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data, times a factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * times


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the cluster names; a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagewarrant-"))
    return df.checkpoint()


def counted(df: DataFrame, **more: F.Column) -> tuple:
    """A checkpoint, its number of rows and the given aggregates over it, told by the job that writes it."""
    seen, told = Observation(), [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]]
    df = checkpoint(df.observe(seen, *told))
    got = seen.get or df.agg(*told).first().asDict()  # a plan found to be empty may tell nothing
    return df, *[got[k] for k in ("n", *more)]


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def few(keys: DataFrame, most: int = BROADCAST_KEYS, n: int | None = None) -> DataFrame:
    """A table of keys, marked for broadcast if it has at most ``most`` rows; counted first, unless their number is given."""
    n = keys.limit(most + 1).count() if n is None else n
    return F.broadcast(keys) if n <= most else keys


def sampled(rows: DataFrame, n: int, id_col: str = "_k_id", n_rows: int | None = None) -> DataFrame:
    """The ``n`` rows with the least hash of their id: a repeatable sample.

    Rows are counted (unless their number is given) and cut by hash to about
    twice the sample before they are ordered, so a task sends few rows however
    many there are.
    """
    key, top = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), 1 << 40
    n_rows = rows.count() if n_rows is None else n_rows
    least = 2 * n + 1000
    if n_rows > least:
        rows = rows.where(key < int(top * (least / n_rows)))
    return rows.orderBy(key, id_col).limit(n)


def _least_texts(batches):
    least: dict = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for i, text, label in zip(*(batch.column(n).to_pylist() for n in ("_k_id", "_k_text", "label"))):
            if i not in least or least[i][0] is None or (text is not None and text < least[i][0]):
                least[i] = (text, label)
    if schema is not None:
        columns = {"_k_id": list(least), "_k_text": [t for t, _ in least.values()], "label": [x for _, x in least.values()]}
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], schema.field(n).type) for n in schema.names], schema=schema)


def one_text(own: DataFrame, ids: DataFrame) -> DataFrame:
    """``_k_text, label`` of each chosen id (``_k_id, label``), once however many rows it has: the least of its texts.

    A task sends one row of an id at most, so repeated ids are no load.
    """
    rows = own.select("_k_id", "_k_text").join(F.broadcast(ids), "_k_id").select("_k_id", "_k_text", "label")
    return rows.mapInArrow(_least_texts, rows.schema).groupBy("_k_id").agg(F.min("_k_text").alias("_k_text"), F.max("label").alias("label")).select("_k_text", "label")


def release() -> None:
    """Give memory that a task has freed back to the system, for the workers that go on to other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def releasing(f):
    """A function of one Arrow table that releases memory when it is done."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    return one


def releasing_two(f):
    """The same for a function of two tables."""

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    return two


def releasing_batches(f):
    """The same for a function of an iterator of batches."""

    def batches(it):
        try:
            yield from f(it)
        finally:
            release()

    return batches


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the folder that the cluster names for checkpoints; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="pagewarrant-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder: columns that are not needed later are not read again."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
