"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names in ``spark.checkpoint.dir`` (or the caller has set).

    Only on one machine (tests) a temporary one is made; on a cluster that
    names none this is an error, for a folder of the driver is nobody else's.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once, here.

    Catalyst copies an expression into every filter and projection that uses it,
    which multiplies long chains of derived columns; a generator of one row
    keeps the columns' definitions below it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*[F.col(f"`{n}`") for n in names]))))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, if the input comes in fewer pieces than there are cores (one small file); larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if pieces >= cores else df.repartition(cores)
