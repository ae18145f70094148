"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "reviewmill", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; everything else stays overridable."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own;
    a cluster without it is an error, since a machine-local folder is lost with
    its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_FOLDERS[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage (executors may be lost), is computed once however
    often it is used, and carries its true size, so Catalyst broadcasts it in a
    join only while it is below ``spark.sql.autoBroadcastJoinThreshold`` and
    shuffles it otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path.getFileSystem(conf).delete(path, True)


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are evaluated once per row.

    A plain ``withColumn`` is inlined into every filter pushed below it and so
    evaluated again for each; a generator of one row is not.
    """
    made = F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))
    return df.select("*", F.inline(made))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows typed in by the caller as a local relation: known size, no Python worker."""
    fields = T.StructType.fromDDL(schema)
    columns = {field.name: [row[i] for row in rows] for i, field in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns), fields)


def exploded(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of a computed array.

    The plain generator makes the planner test the array's size in a filter of
    its own, which computes the array twice; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def lookup(spark: SparkSession, rows: DataFrame | list[tuple], schema: str) -> DataFrame:
    """A lookup table given either as a DataFrame or as literal rows."""
    return rows if isinstance(rows, DataFrame) else literal_table(spark, rows, schema)
