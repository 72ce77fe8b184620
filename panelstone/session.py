"""Session helpers: builder defaults for local runs and a durable place to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the test-suite and the benchmark use.

    On a cluster the session comes from the platform; nothing in the library reads these values.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelstone")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` for intermediate data.

    A session on one machine (``local[...]``, as in tests) that names none gets a folder of its own, removed when Python ends. On a
    cluster a missing setting is an error: executors could not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="panelstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several consumers: they read columns of a file instead of repeating a long plan, and losing an
    executor never replays more than the stage at hand. The table is removed when its session's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of table files that make one part where rows are widened and sorted: 4 MB of lines hold some 300,000 price rows.
PART_BYTES = 4 << 20


def parts_of(df: DataFrame, part_bytes: int | None = None) -> int:
    """One part for each ``part_bytes`` of the files that ``df`` reads, and at least one for each core.

    Nothing runs here: only the lengths of the files are asked for.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)) for x in df.inputFiles()]
    read = sum(x.getFileSystem(conf).getFileStatus(x).getLen() for x in paths)
    return max(spark.sparkContext.defaultParallelism, -(-read // (part_bytes or PART_BYTES)))


def dealt(df: DataFrame, *keys: str, part_bytes: int | None = None) -> DataFrame:
    """Deal rows by ``keys`` into parts whose number grows with the files that ``df`` reads, one for each ``PART_BYTES``.

    The parts of an ordinary shuffle are limited in number, and adaptive execution joins them by their narrow, compressed size; a chain of
    windows that widens the rows then holds ever more in one task.
    """
    return df.repartition(parts_of(df, part_bytes), *keys)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stage table; nothing to do once the session is gone."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended first; the folder's owner cleans up then
        return


def stacked(top: DataFrame, other: DataFrame, allowMissingColumns: bool = False) -> DataFrame:
    """Union by name that never claims its inputs' partitioning.

    Spark 4.1 lets a union of equally partitioned inputs skip the following shuffle, but adaptive execution may coalesce each
    input's partitions differently, and rows of one key then land in several output partitions (groups come out twice). The
    claim is switched off; the aggregation or window after the union shuffles once, as it always did.
    """
    top.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return top.unionByName(other, allowMissingColumns)
