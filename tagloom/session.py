"""Session defaults, lineage cuts and size checks shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count that may be brought to the driver or shipped to every task.
BROADCAST_ROWS = 65_536
BROADCAST_BYTES = 64 * 1024 * 1024

_local_roots: dict[str, str] = {}
_stages: dict[tuple[str, str, str], tuple[str, object]] = {}


def build_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "tagloom") -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as named by the cluster; a local session gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-tagloom-")
    return _local_roots[app]


def new_stage_path(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with some settings (names with _ for .) for what is planned and run inside; then as it was."""
    named = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Write the frame; the shuffle files of its plan go as soon as it is written, so a long job holds those of one step only."""
    with configured(df.sparkSession, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        writer = df.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def cut_lineage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it back: a lost executor never replays the past,
    and later joins are planned from real sizes."""
    spark = df.sparkSession
    path = new_stage_path(spark, label)
    write_once(df, path, partition_by)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table several jobs share: built once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _stages:
        df = build()
        path = new_stage_path(spark, label)
        write_once(df, path)
        _stages[key] = (path, df.schema)
    path, schema = _stages[key]
    return spark.read.schema(schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most `rows` rows; reads no further than one row past the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits(df, rows) else df
