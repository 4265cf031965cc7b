"""Session helpers: configuration, the shared scratch folder, written intermediates."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scratch: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkstone")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or our own where that is unset (local mode only)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        own = tempfile.mkdtemp(prefix="inkstone-")
        atexit.register(shutil.rmtree, own, True)
        _own_dirs[sc.applicationId] = own
    return _own_dirs[sc.applicationId]


def filesystem(uri: str):
    """(file system, path) of a URI or local path, as the workers' Python sees it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/inkstone/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what operators have written to the shared folder so far; frames made of it cannot be computed after that."""
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer partitions than cores (one small file), spread by key before costly Python work.

    Large inputs have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)


def spread_again(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """An aggregate of a small `source`, spread by key before costly Python work.

    Adaptive execution joins the partitions of a small aggregate to one, which one core would then work through. Where the
    source's size is enough for a partition of the advised size on every core, nothing is done.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    advised = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
    return df if size >= advised * cores else df.repartition(2 * cores, *keys)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever their working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".txt", ".tsv", ".json"):
                z.write(path, path.relative_to(root.parent))
    try:
        folder = shared_dir(spark)
    except ValueError:  # a cluster without a shared folder: the driver hands the file out itself
        folder = tempfile.mkdtemp(prefix="inkstone-ship-")
        atexit.register(shutil.rmtree, folder, True)
    target = f"{folder}/inkstone/package-{uuid.uuid4().hex}.zip"
    system, path = filesystem(target)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(buffer.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
