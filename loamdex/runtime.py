"""Session handling and the few physical-plan helpers the operators share.

Nothing here collects data.  The helpers exist so that every operator takes the
same decisions about lineage (:func:`materialize`), broadcasts
(:func:`join_bounded`) and hot keys (:func:`frequent_keys`).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes by the widths of its columns, up to which a side may be broadcast after it was counted.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20


def get_session(app: str = "loamdex", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use; a running session is returned as it is."""
    if (active := SparkSession.getActiveSession()) is not None:
        return active
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable for the Python workers of a session, once an application.

    Local workers that inherit the driver's path or folder find it already;
    others get it from the driver as a zip file.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master.startswith("local") and (root in inherited or context.master.startswith("local[") and Path.cwd() == root):
        return
    folder = tempfile.mkdtemp(prefix="loamdex-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/loamdex.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted((root / "loamdex").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(target)


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    be unreadable for the other executors.
    """
    ship(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="loamdex-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the input a single time and stores it
    column by column; unlike ``localCheckpoint`` it survives a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamdex/{''.join(f'{name}/' for name in _SCRATCH)}{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes inside are deleted at the end; results have to be written or collected before."""
    name = f"scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(name)
    try:
        yield
    finally:
        at = "".join(f"{s}/" for s in _SCRATCH)
        _SCRATCH.pop()
        _delete(spark, f"{shared_dir(spark)}/loamdex/{at}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession) -> None:
    """Delete all tables that :func:`materialize` left in the shared folder; results that were not computed before fail then."""
    _delete(spark, f"{shared_dir(spark)}/loamdex")


def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The materialized ``df`` and its row count (read from the footers)."""
    kept = materialize(df, tag)
    return kept, kept.count()


def join_bounded(big: DataFrame, small: DataFrame, on, rows: int, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small``, whose row count is known: broadcast within ``limit`` rows and ``BROADCAST_BYTES``.

    Beyond that the join shuffles; AQE then splits skewed partitions.
    """
    fits = rows <= limit and rows * width_of(small) <= BROADCAST_BYTES
    return big.join(F.broadcast(small), on, how) if fits else big.join(small.hint("merge"), on, how)


def width_of(df: DataFrame) -> int:
    """Bytes that a row may take in memory: 16 for a number, 256 for a text, 4096 for arrays, binaries and structs."""
    simple = {"string": 256, "binary": 4096}
    return sum(simple.get(kind, 4096 if "<" in kind else 16) for _, kind in df.dtypes)


def frequent_keys(df: DataFrame, key: str, distinct: str, least: int) -> DataFrame:
    """Values of ``key`` seen with ``least`` or more different values of ``distinct``: (key, n).

    A first pass counts rows, so only keys with enough rows reach the distinct
    count.  Both passes combine on the map side; the second first groups by
    (key, distinct), so that a hot key is spread over all tasks.
    """
    common = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    kept, rows = counted(common, "frequent")
    pairs = join_bounded(df.select(key, distinct), kept, key, rows, "left_semi").where(F.col(distinct).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a costly column that later filters do not compute a second time.

    The optimizer pushes a filter on a projected column below the projection by
    repeating its expression; it does not push one below a generator.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def data_path(name: str, default: str) -> str:
    """A path parameter that an environment variable can override."""
    return os.environ.get(name, default)


def blank(text: Column) -> Column:
    """True for null and white-space-only text, with white space as Python defines it."""
    return text.isNull() | (F.length(F.regexp_replace(text, WHITE, "")) == 0)


#: White space as Python's ``str.isspace`` has it, as a Java character class.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
