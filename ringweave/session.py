"""Session helpers: a local session for tests and benches, and what any session needs."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """Session for one machine. On a cluster use your own and call ``prepare``."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ringweave")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Rows here are a hundred bytes and tens of microseconds of work: partitions far
        # below the default 1 MB still pay, and coalescing to one would leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        # Methods the JIT refuses (over 8000 bytes of code) run faster split per operator.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers (once per application).

    The package goes as one zip file into the checkpoint folder, which every node
    reaches, and from there to the workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    package = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_dir(spark)}/ringweave-{context.applicationId}.zip"
    )
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path, True)
    out.write(content.getvalue())
    out.close()
    context.addPyFile(files.makeQualified(path).toString())
    _shipped.add(context.applicationId)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for level tables")
    fallback = os.path.join(tempfile.gettempdir(), f"ringweave-{context.applicationId}")
    os.makedirs(fallback, exist_ok=True)
    return fallback


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``materialise`` into a catalog table of ``buckets`` buckets of ``key``.

    Joins and aggregates on ``key`` read it where it lies, without another shuffle. What was
    last shuffled by ``key`` into as many partitions is written as one file a bucket.
    """
    spark = df.sparkSession
    table = f"ringweave_{name}".replace("/", "_").replace("=", "_").replace("-", "_")
    writer = df.write.format("parquet").mode("overwrite")
    writer.option("path", f"{checkpoint_dir(spark)}/{name}").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def discard(spark: SparkSession, name: str) -> None:
    """Delete what ``materialise`` wrote under a name prefix folder, and the tables in it."""
    prefix = f"ringweave_{name}_".replace("/", "_").replace("=", "_").replace("-", "_")
    for table in spark.catalog.listTables():
        if table.name.startswith(prefix):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table under the checkpoint folder and read it back.

    Cuts lineage so that a lost executor costs one level at most, computes the
    rows once, and gives Catalyst an exact size for its join choices.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
