"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this process where it names none and Spark is local."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="loomstack-")
    return _own_dir


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a file of a narrow table.
ROWS_A_FILE = 1 << 17


class Table:
    """A DataFrame written to the shared folder; lineage ends here.

    ``rows`` says about how many narrow rows (keys, links, counts) there are at
    most: where ``ROWS_A_FILE`` of them make fewer files than there are shuffle
    partitions, a task writes up to four partitions, so that they are no heap of
    tiny files.  (It takes no more, as what one partition's join sorts may be
    held until its task ends.)
    """

    def __init__(self, df: DataFrame, tag: str, rows: int | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        if rows is not None:
            quarter = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, quarter, -(-rows // ROWS_A_FILE)))
        # No job looks for a mark of success: a failed write raises.
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _tables.append((self.spark, self.path))

    def drop(self) -> None:
        """Delete the files once no later step reads them."""
        delete(self.spark, self.path)
        _tables.remove((self.spark, self.path))


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return
