"""Session settings and the helpers that depend on the cluster: where a lineage
cut is written, and how the package reaches the executors."""

from __future__ import annotations

import contextlib
import os
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tabweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect.  On a cluster, pass no
    master and leave partition counts to the cluster's own defaults."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
        cores = master.partition("[")[2].rstrip("]")
        settings["spark.sql.shuffle.partitions"] = cores if cores.isdigit() else "8"
        settings["spark.ui.enabled"] = "false"
        settings["spark.driver.memory"] = "12g"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session: their Python workers import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_tabweave_shipped", False):
        return
    home = pathlib.Path(__file__).resolve().parent
    name = pathlib.Path(tempfile.mkdtemp(prefix="tabweave-package-")) / "tabweave.zip"
    with zipfile.ZipFile(name, "w") as package:
        for file in sorted(home.rglob("*.py")):
            package.write(file, file.relative_to(home.parent))
    sc.addPyFile(str(name))
    sc._tabweave_shipped = True


#: Labels and ids lie in their files at a small part of what their rows take in memory, down to a fiftieth.
MEMORY_OF_FILES = "50"
#: So much of a file or shuffle goes to one task, as its rows take many times that: a task's memory then stays the same while the input grows.
BYTES_OF_A_TASK = 8 << 20
_TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def _bytes(size: str) -> int:
    """A size as settings spell it, such as 64MB, 8m or 67108864b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def prepare(spark: SparkSession) -> None:
    """Let the planner reckon a file by its rows in memory, so that it broadcasts none that only its encoding makes small and gives
    no task more than ``BYTES_OF_A_TASK`` of them, and let the shuffle files of a finished step go.  A lower limit that is set stays."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", MEMORY_OF_FILES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for name in _TASK_SIZES:
        if _bytes(spark.conf.get(name)) > BYTES_OF_A_TASK:
            spark.conf.set(name, f"{BYTES_OF_A_TASK}b")


@contextlib.contextmanager
def joined_where_they_lie(spark: SparkSession):
    """Joins planned meanwhile leave rows that lie by a part of the keys, evenly dealt by the caller, where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage cuts are written to.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    every task runs on this machine, may fall back to a folder made here."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tabweave-ckpt-", dir=os.environ.get("TMPDIR") or None)
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    A lost executor then re-reads files instead of replaying earlier rounds, a
    result used several times is computed once, and the planner knows its size."""
    prepare(df.sparkSession)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tabweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
