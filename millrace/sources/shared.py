"""The shared folder: tables and checkpoints that outlive executors, and go when the driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_shared_dir(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says (spark.checkpoint.dir). Only a local master may go without: it gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        context.setCheckpointDir(path)


def shared_dir(spark: SparkSession) -> str:
    use_shared_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Paths of intermediate tables that are not yet freed.
_held: list[str] = []


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder for an intermediate table; it is deleted by `free`, or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(_hadoop_path(spark, path))
    _held.append(path)
    return path


def free(spark: SparkSession) -> int:
    """Deletes the intermediate tables made so far, for a long session between queries whose results are stored: what was
    made from them can't be read any more. Gives their number."""
    gone, _held[:] = list(_held), []
    for path in gone:
        _file_system(spark, path).delete(_hadoop_path(spark, path), True)
    return len(gone)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table(df: DataFrame) -> DataFrame:
    """df by way of a table in the shared folder: computed once, safe from lost executors, of a size known to the planner."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """df by way of a table in buckets of a column: each later join by that column deals out the other side alone.

    As many buckets as the session has shuffle partitions, unless told otherwise.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"millrace_{uuid.uuid4().hex}"
    try:
        df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", new_path(spark, "buckets")).saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone: the files are its owner's, and what is given back knows them


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder, so that a lost executor costs no earlier stage."""
    use_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: As many files have their names broadcast, some tens of MB, to number the rows by place.
MOST_FILES = 200_000


def is_scan(df: DataFrame) -> bool:
    """Whether df is what a file source reads, but for filters and projections, so that each row has a place of its own."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in df.columns}


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with one more column that numbers its rows, and that column's name.

    Each later job sees the same numbers, however many cores there are and wherever df comes from; a number taken anew in
    each job changes with the splits. Rows of Parquet files are numbered by their file and place in it, without a copy;
    others are written with their numbers.
    """
    used = {c.lower() for c in df.columns}
    name, file, place, count = ("row" + "_" * next(i for i in range(99) if f"row{'_' * i}{end}" not in used) + end for end in ("", "file", "place", "count"))
    if is_scan(df):
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        except AnalysisException:  # no Parquet files
            placed = None
        if placed is not None:
            # One row a file.
            files = table(placed.select(file).distinct().withColumn(count, F.row_number().over(Window.orderBy(file)).cast("long")))
            if files.count() <= MOST_FILES:
                at = F.shiftleft(count, 40).bitwiseOR(F.col(place))
                return placed.join(F.broadcast(files), file).select(*[F.col(f"`{c}`") for c in df.columns], at.alias(name)), name
    return table(df.withColumn(name, F.monotonically_increasing_id())), name
