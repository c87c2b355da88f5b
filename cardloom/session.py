"""Session settings and small helpers that need the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cardloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf adds or overrides settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; set a local one only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cardloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the checkpoint folder and read it: columns prune, sizes are known, joins deal it anew."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = uuid.uuid4().hex
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{name}"
    df.write.parquet(path)
    _WRITTEN[name] = path
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, to be joined by its keys over all tasks and never broadcast.

    For sides that grow with the input: columns of equal or rising values take few bytes in a shuffle or file, so such a
    table counts as small there, and is hundreds of megabytes once the driver builds it.
    """
    return df.hint("merge")


#: Rows up to which a table may be broadcast whatever they hold.
FEW_ROWS = 50_000


def spread_if_many(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """df, spread once rows (a written table as long as df; df itself) has more than FEW_ROWS: short tables join faster by broadcast, and size in bytes misleads."""
    return spread(df) if (df if rows is None else rows).limit(FEW_ROWS + 1).count() > FEW_ROWS else df


#: Tables that written() has made in this process, by the name of their folder.
_WRITTEN: dict[str, str] = {}


def written_so_far() -> set[str]:
    """Names of the tables that written() has made and that are still there."""
    return set(_WRITTEN)


def discard_tables(*keep: DataFrame, before: set[str] | None = None) -> int:
    """Delete the tables that written() has made, but for those that keep reads and those of before; how many were deleted.

    For the borders of a pipeline, where all that came before is written in keep, and for the end of steps that
    know all tables made since before; results that have not been written out yet must not be read afterwards.
    """
    spark = keep[0].sparkSession
    read = {file.rsplit("/", 2)[-2] for df in keep for file in df.inputFiles()} | (before or set())
    gone = [name for name in _WRITTEN if name not in read]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(name))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a directory, read by Spark whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
