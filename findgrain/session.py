"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "findgrain", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session as used by tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; a local one is made only where none is set."""
    set_by_cluster = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    import tempfile

    path = "file://" + tempfile.mkdtemp(prefix="findgrain-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_made: dict[str, list[str]] = {}


_kept: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder for a table; one to ``keep`` outlives the scratch of the call that makes it."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (_kept if keep else _made).setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def _delete(spark: SparkSession, made: list[str]) -> None:
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for at in made:
        path = path_of(at)
        path.getFileSystem(conf).delete(path, True)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables this application wrote to the shared folder on its way. DataFrames that still read them are lost."""
    made = _made.pop(spark.sparkContext.applicationId, []) + _kept.pop(spark.sparkContext.applicationId, [])
    _delete(spark, made)
    return len(made)


@contextmanager
def scratch(spark: SparkSession):
    """Tables made inside are deleted on the way out; what is made of them must be complete by then."""
    key = spark.sparkContext.applicationId
    before = _made.get(key, [])
    _made[key] = []
    try:
        yield
    finally:
        made, _made[key] = _made[key], before
        _delete(spark, made)


def through_table(df: DataFrame, name: str, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    at = fresh_dir(spark, name, keep)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(at)
    return spark.read.schema(df.schema).parquet(at) if not partition_by else spark.read.parquet(at)


def local_rows(spark: SparkSession, rows: list, schema: StructType | str) -> DataFrame:
    """Few rows of the driver as a relation whose size the planner knows, so that joins with it are broadcast."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where their files give fewer partitions than that, as one small file does.

    Only names and sizes of files are looked at; nothing of the plan is run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    largest = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = 0
    for name in files:
        path = path_of(spark._jvm.java.net.URI(name))
        parts += -(-path.getFileSystem(conf).getFileStatus(path).getLen() // largest)
    return df if parts >= cores else df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
