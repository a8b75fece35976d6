"""Session defaults and the staging of intermediate results."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_shipped: dict[str, tempfile.TemporaryDirectory] = {}
_shipping = threading.Lock()


def local_session(cpus: int | str = 8, app: str = "paramill", **settings: str) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # call sites of every column expression are slow to record
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # longer generated methods are never compiled by the JVM, so let Spark split them
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-machine session may
    fall back to a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="paramill-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def stage(df: DataFrame, label: str, parallel: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    Costly results with several readers are computed a single time, readers get column
    pruning, and a lost executor costs a re-read instead of a recomputation. ``parallel``
    is for tables that are read many times over: a table of fewer files than cores, hence a
    small one, is written again in one file per core.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if not parallel or staged.rdd.getNumPartitions() >= cores:
        return staged
    wide = f"{path}-wide"
    staged.repartition(cores).write.parquet(wide)
    drop_stage(staged)
    return spark.read.schema(df.schema).parquet(wide)


def drop_stage(df: DataFrame) -> None:
    """Delete the table that :func:`stage` wrote for ``df`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "-stage-" not in name:
            continue
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, key: str, task_rows: int | None = None) -> DataFrame:
    """Give a scan of few file splits one partition per core before CPU-heavy work, or one per ``task_rows``
    rows if these are more, so that no task grows with a table that lies in few files.

    Only for plain scans, whose rows the files' footers tell. Inputs with enough splits pass untouched.
    """
    parts = scan.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        parts = max(parts, -(-scan.count() // task_rows))
    return scan.repartition(parts, key) if scan.rdd.getNumPartitions() < parts else scan


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    with _shipping:  # several threads of the driver may fit models
        if context.applicationId in _shipped:
            return
        top = Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory(prefix="paramill-source-")  # the driver serves the file while it runs
        name = f"{folder.name}/paramill-source.zip"
        with zipfile.ZipFile(name, "w") as z:
            for path in sorted(top.rglob("*.py")):
                z.write(path, str(path.relative_to(top.parent)))
        context.addPyFile(name)
        _shipped[context.applicationId] = folder
