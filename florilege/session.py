"""Session defaults and the shared folder for cut lineage and stored tables."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the library's defaults, for tests, benchmarks and scripts."""
    builder = SparkSession.builder.master(master).config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local master gets a temporary folder of its own.

    On a cluster without the setting this raises ValueError: a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured
    made = getattr(context, "_florilege_folder", None)
    if made is None:
        if not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = context._florilege_folder = tempfile.mkdtemp(prefix="florilege-")
    return made


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the session has been given one already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """Compute df once, write it to the shared folder and continue from the written copy.

    replaced: earlier copies of which nothing but df was still to be made; their files are deleted once df is written, so
    that a loop keeps one round on disk.
    """
    ensure_checkpoint_dir(df.sparkSession)
    copy = df.checkpoint(eager=True)
    for old in replaced:
        release(old)
    return copy


def release(copy: DataFrame) -> None:
    """Delete the files of a frame that `cut` returned; nothing may be computed from it afterwards."""
    plan = copy._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = copy.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(copy.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_florilege_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="florilege-")) / "florilege_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._florilege_shipped = True
