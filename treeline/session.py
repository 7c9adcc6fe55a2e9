"""Session helpers: a tuned local session for tests, and the checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "treeline", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine.

    On a cluster the session comes from ``spark-submit``; nothing in the package depends on the values
    set here apart from ``spark.sql.session.timeZone``, which every date column assumes to be UTC.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder intermediate tables go to; every executor has to reach it.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a temporary
    folder, because there driver and executors are one process.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="treeline-checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return own


_cuts: list[str] = []
#: Spark's own setting that removes a query's shuffle files when it ends, not when the driver next collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and reads it back.

    What is built on the result starts from a written table: several consumers do not repeat the work
    before it, a lost executor costs no recomputation, columns are still pruned and the optimiser knows the
    size. :func:`release` removes one such table, :class:`job_tables` all that a job wrote. Shuffle files of the
    write go with its end: what follows reads the table.
    """
    spark = df.sparkSession
    place = f"{checkpoint_dir(spark).rstrip('/')}/treeline-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)
    _cuts.append(place)
    written = spark.read.schema(df.schema).parquet(place)
    written._cut_place = place
    return written


#: Spark's own setting for the most tasks that list folders; by default a folder is a task, up to 10,000.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def folders_listed_together(spark: SparkSession) -> Iterator[None]:
    """Inside, readers list the folders below a path in four tasks a core: listing a small folder takes less than starting a task for it."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(LISTING, before) if before is not None else spark.conf.unset(LISTING)


def _delete(spark: SparkSession, place: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def release(*tables: DataFrame) -> None:
    """Deletes the given tables of :func:`cut`, as soon as nothing reads them any more."""
    for table in tables:
        place = table._cut_place
        if place in _cuts:
            _cuts.remove(place)
            _delete(table.sparkSession, place)


class job_tables:
    """Deletes, at the end of the block, the tables that :func:`cut` wrote inside it and no others.

    The result has to be written before the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> job_tables:
        self.before = set(_cuts)
        return self

    def __exit__(self, *_) -> None:
        for place in [x for x in _cuts if x not in self.before]:
            _cuts.remove(place)
            _delete(self.spark, place)


def drop_cuts(spark: SparkSession) -> int:
    """Deletes the tables that :func:`cut` wrote in this process; their DataFrames are void afterwards."""
    dropped = 0
    while _cuts:
        dropped += _delete(spark, _cuts.pop())
    return dropped
