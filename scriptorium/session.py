"""Sessions, test tables and durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE, Arrow).

    On a cluster leave ``master`` unset: spark-submit decides it, and also memory,
    shuffle partitions and ``spark.checkpoint.dir``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the test tables; a Parquet file or folder ``<directory>/<name>.parquet``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting: it then gets a temporary folder,
    since its one process is the whole cluster. Elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    known = _LOCAL.get(id(spark.sparkContext))
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    _LOCAL[id(spark.sparkContext)] = base
    return base


_LOCAL: dict[int, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def durable(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage without depending on any single executor: the files survive the
    loss of all of them. Columns keep names and types. The files go when the driver ends, or by
    ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing reads any more, as the last round's
    table of an iteration; other tables are left alone."""
    path = getattr(df, "_written", None)
    if path is None:
        return
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


@atexit.register
def _drop_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; the folder's owner cleans then
            pass
    for base in _LOCAL.values():
        import shutil

        shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions to ask for where an explicit number is needed."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tokenizer_folder() -> str:
    """Default folder of the public vocabularies; every operator also takes it as a parameter."""
    return os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


_SHIPPED: set[int] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context; they may not have it on their path."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="scriptorium-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith((".py", ".txt")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("scriptorium", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(id(sc))


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
