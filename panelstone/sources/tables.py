"""Reading and writing declared tables, partitioned signals, and small dictionaries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from panelstone.session import remove, stacked
from panelstone.sources.contracts import TABLES, TableSpec, check, coerce, migrate, raise_on, schema_problems


def _spec(name: str | TableSpec) -> TableSpec:
    return TABLES[name] if isinstance(name, str) else name


def path_of(root: str, spec: TableSpec) -> str:
    """Folder of a table; its versions are the folders ``v00000001``, ``v00000002``, ... in it."""
    return f"{root}/{spec.layer}/{spec.name}"


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str, name: str | TableSpec) -> list[int]:
    """Numbers of the complete versions of a table, oldest first (at most two are kept)."""
    target, fs = _folder(spark, path_of(root, _spec(name)))
    if not fs.exists(target):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(target)]
    return sorted(int(x[1:]) for x in names if re.fullmatch(r"v\d{8}", x))


def current(spark: SparkSession, root: str, name: str | TableSpec) -> str:
    """Path of the newest version; that of the first one when the table has none yet."""
    known = versions(spark, root, name)
    return f"{path_of(root, _spec(name))}/v{known[-1] if known else 1:08d}"


def scan(spark: SparkSession, root: str, name: str | TableSpec) -> DataFrame:
    """Lazy scan: filters and projections reach the Parquet reader."""
    return spark.read.parquet(current(spark, root, name))


def read(spark: SparkSession, root: str, name: str | TableSpec, required: bool = False) -> DataFrame | None:
    """Table migrated to its declared schema; None when it does not exist (an error when required)."""
    spec = _spec(name)
    try:
        df = scan(spark, root, spec)
    except AnalysisException as exc:
        # Only a missing path means "no table"; anything else (permissions, a broken file) must not pass for one.
        if required or exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return coerce(migrate(df, spec), spec)


def write(df: DataFrame, root: str, name: str | TableSpec, partition_by: list[str] | None = None) -> str:
    """Replace the table: written aside, checked as written, then moved into place as the next version by one rename.

    A job that dies or breaks the contract leaves the table as it was. The frame is computed once; readers of the version before are not
    disturbed, older ones are removed. One of two writers that meet gets an error, as a version is never replaced. Needs a file system
    whose folders move in one step (HDFS, local disks).
    """
    spec, spark = _spec(name), df.sparkSession
    raise_on(schema_problems(df, spec), [], spec.name)
    base, known = path_of(root, spec), versions(spark, root, spec)
    aside = f"{root}/{spec.layer}/.staging/{spec.name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(aside)
        check(spark.read.schema(spec.schema).parquet(aside), spec)
        number = known[-1] + 1 if known else 1
        _move(spark, aside, base, f"v{number:08d}")
    except BaseException:
        remove(spark, aside)
        raise
    for old in known[:-1]:
        remove(spark, f"{base}/v{old:08d}")
    return f"{base}/v{number:08d}"


def _move(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """Rename ``source`` to ``folder/name``; an error if that exists."""
    jvm = spark._jvm
    target, fs = _folder(spark, folder)
    fs.mkdirs(target)
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(source)), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target, name)), options)


def merge_newest(existing: DataFrame | None, incoming: DataFrame, spec: TableSpec, sequence: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows win over existing ones with the same key; of several incoming ones the last by ``sequence`` wins, whatever its value.

    Rows of a frame have no order of their own: ``sequence`` names the columns of the incoming frame (declared or not) that hold it, such as
    a load number or the time of recording; a null comes first. What they leave equal is settled by the values, so that a recomputed task
    chooses alike. Reduced by an aggregate per key, so copies of a key combine map-side.
    """
    names = [f.name for f in spec.schema]
    order = [f"_seq{i}" for i, _ in enumerate(sequence)]
    both = incoming.select(*[F.col(x) for x in names], *[F.col(x).alias(n) for x, n in zip(sequence, order)], F.lit(1).alias("_p"))
    if existing is not None:
        both = existing.select(*names, F.lit(0).alias("_p")).transform(stacked, both, allowMissingColumns=True)
    rest = [x for x in names if x not in spec.key]
    best = F.max_by(F.struct(*rest), F.struct("_p", *order, *rest)) if rest else F.max(F.lit(None))
    merged = both.groupBy(*spec.key).agg(best.alias("_r"))
    return merged.select(*spec.key, *(["_r.*"] if rest else [])).select(*names)


def upsert(df: DataFrame, root: str, name: str | TableSpec, sequence: tuple[str, ...] = ()) -> str:
    """Replace rows by key, the last of a load by ``sequence`` winning. The merged rows become the next version of the table."""
    spec = _spec(name)
    incoming = coerce(df, spec)
    extra = [x for x in sequence if x not in incoming.columns]
    if extra:
        typed = {f.name: f.dataType for f in spec.schema}
        incoming = df.select(*[(F.col(n).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in typed.items()], *extra)
    return write(merge_newest(read(df.sparkSession, root, spec), incoming, spec, sequence), root, spec)


def recorded(existing: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys of a stored table, to be joined sorted: a few compressed MB of them may be millions, too many to gather in the driver."""
    return existing.select(*spec.key).hint("merge")


def append(df: DataFrame, root: str, name: str | TableSpec) -> str:
    """Append-only: an incoming key that already exists is an error."""
    spec = _spec(name)
    existing = read(df.sparkSession, root, spec)
    if existing is not None:
        clash = df.join(recorded(existing, spec), list(spec.key), "left_semi")
        if not clash.isEmpty():
            raise ValueError(f"{spec.name}: incoming keys already recorded")
    elif not versions(df.sparkSession, root, spec):
        return write(df, root, spec)
    target = current(df.sparkSession, root, spec)
    check(df, spec).write.mode("append").option("compression", "zstd").parquet(target)
    return target


def write_signals(signals: DataFrame, root: str) -> str:
    """Rows with a full key, partitioned by kind and date. Rows are spread within a partition value, so no kind becomes one file."""
    keyed = signals.dropna(subset=["uid", "entity", "kind", "asof"])
    keyed.write.mode("append").partitionBy("kind", "asof").parquet(f"{root}/signals")
    return f"{root}/signals"


def load_signals(spark: SparkSession, root: str, kind: str, start: str, end: str) -> DataFrame:
    """Signals of one kind in a date range; both predicates prune partitions."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/signals")
    return df.where((F.col("kind") == kind) & F.col("asof").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_partition(df: DataFrame, root: str, layer: str, source: str, dt: str) -> str:
    """Replace one date partition of a source and leave the others alone."""
    target = f"{root}/{layer}/{source}"
    df.withColumn("dt", F.lit(dt)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(target)
    return target


def read_partition(spark: SparkSession, root: str, layer: str, source: str, dt: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{layer}/{source}").where(F.col("dt") == F.lit(dt).cast("date"))


def read_csv_series(spark: SparkSession, path: str, date: str, value: str, null: str = ".") -> DataFrame:
    """Two-column series with a sentinel for missing values; unreadable rows are dropped."""
    raw = spark.read.option("header", True).option("nullValue", null).csv(path, schema=f"`{date}` string, `{value}` string")
    out = raw.select(F.col(date).try_cast("date").alias("date"), F.col(value).try_cast("double").alias("value"))
    return out.dropna()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Domain-to-ticker dictionary."""
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumns({"domain": F.lower("domain"), "ticker": F.upper("ticker")})
