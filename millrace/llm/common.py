"""Shared plumbing of the text operators.

Every operator selects the columns it needs before doing anything else, so extra columns with
clashing names in the input cannot disturb it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an intermediate up to which it is read by no more tasks than cores.
FEW_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run in one process."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Python tasks of what is evaluated inside get batches of `rows` rows: whole texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Evaluate once into the shared checkpoint folder: cuts lineage and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """cut(df), read by no more tasks than cores if it has few rows.

    Rounds over small tables would else start tasks, and leave files, for every partition of every shuffle before them.
    The rows are counted while they are written.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out.coalesce(df.sparkSession.sparkContext.defaultParallelism) if seen.get["n"] <= FEW_ROWS else out


def release(spark: SparkSession) -> None:
    """After rounds of cuts: Spark deletes the shuffle files of a finished round once the driver has
    collected what referred to them, which may otherwise be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def rest(spark: SparkSession) -> None:
    """Between steps: executors collect their garbage, and so hand heap that they no longer use back to the system.

    An executor's heap grows with the rows that a native step makes and stays as large as it ever was, which would be
    missing beside it in the Python workers of the step after. Tasks fill all cores, so each executor gets one.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like cut(), as Parquet: compressed and prunable by column, for the larger intermediates."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediates of one operator as Parquet in the shared folder, which go when they are of no more use."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.at = spark, f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.paths)}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that stored() gave and that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][1])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        release(self.spark)


def fresh(taken: list[str], *names: str) -> tuple[str, ...]:
    """names, each with underscores before it until no column is called so (in any letter case)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return tuple(out)


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """row (all of df's columns as one struct) beside columns of our own, whose names then clash with none."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def trim() -> None:
    """Hand memory that this process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not on every system
    if free:
        free(0)


def lean(run):
    """run, a function of Arrow batches, that hands the memory of its task back when it is done.

    Workers outlive their tasks; what an allocator keeps in them would be missing in the stages after.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def small_or_not(df: DataFrame, n_rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only when the measured row count is within the limit; else a shuffle join."""
    return F.broadcast(df) if n_rows <= limit else df.hint("merge")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times inside `body` (a lambda on a Column).

    Without this the optimizer may inline an expensive expression into a lambda, where it
    would be evaluated once per element.
    """
    return F.transform(F.array(value), body).getItem(0)


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """Rows that no fit may learn from; a null id cannot be assigned to a fold and is held out."""
    return F.coalesce(id_bucket(doc_id, n) == remainder, F.lit(True))


def sample_ids(keyed: DataFrame, rows: int) -> list:
    """At most `rows` distinct ids of `keyed`, each once with its other (narrow) columns, by a hash of the id.

    Distinct ids are estimated first, so that only about twice `rows` of them pass a threshold on the hash and
    reach the driver, however many tasks there are and however often an id is repeated.
    """
    n = keyed.agg(F.approx_count_distinct("doc_id")).first()[0]
    if not n:
        return []
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = keyed.where(part <= int(min(1.0, 2 * rows / n + 100 / n) * (1 << 40))).dropDuplicates(["doc_id"])
    return near.orderBy(part, "doc_id").limit(rows).collect()


def texts_of(documents: DataFrame, ids: list, max_chars: int, *columns: str) -> list:
    """doc_id, text and columns of one row of each chosen id (first of each of ids): of its non-null texts of up to
    max_chars characters the one with the least hash. So no more rows than ids reach the driver, and a task keeps one
    row of an id before any shuffle."""
    if not ids:
        return []
    chosen = documents.sparkSession.createDataFrame([(r[0],) for r in ids], documents.select("doc_id").schema)
    found = (
        documents.select("doc_id", "text", *columns)
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(chosen), "doc_id")  # as many rows as were sampled
    )
    least = F.min(F.struct(F.xxhash64("text", *columns).alias("h"), "text", *columns)).alias("x")
    return found.groupBy("doc_id").agg(least).select("doc_id", "x.text", *[f"x.{c}" for c in columns]).collect()


class Shipped:
    """A model for the executors, with its class by value, as they may not have this package.

    get() loads it once in a task.
    """

    def __init__(self, spark: SparkSession, model):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def get(self):
        import pickle

        return pickle.loads(self.data.value)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, n: int, remainder: int, rows: int, max_chars: int
) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold.

    The ids are chosen from the labels alone, so only their texts leave the scan of the documents.
    Texts over `max_chars` take no part in a fit.
    """
    keyed = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & ~held_out(F.col("doc_id"), n, remainder))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    ids = sample_ids(keyed, rows)
    label_of = {r.doc_id: r.y for r in ids}
    return sorted((r.doc_id, r.text, label_of[r.doc_id]) for r in texts_of(documents, ids, max_chars))
