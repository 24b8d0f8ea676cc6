"""Shared scratch space: cuts lineage with tables every executor can read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, a fresh local folder, in a local session only."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("graphquarry.scratch.dir", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="graphquarry-")
            spark.conf.set("graphquarry.scratch.dir", at)
    return at.rstrip("/")


_CLEARED_AT_EXIT: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's own folder in the scratch space; it goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(app)
        atexit.register(_clear_quietly, spark)
    return f"{scratch_dir(spark)}/graphquarry/{app}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written; results that still read it are lost."""
    for t in spark.catalog.listTables():
        if t.name.startswith("gq_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    _KEPT.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_quietly(spark: SparkSession) -> None:
    try:
        clear_scratch(spark)
    except Exception:
        pass  # the session has ended before


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    The result has no lineage, carries file statistics for the planner, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, tuple[list, DataFrame]] = {}


def kept(spark: SparkSession, name: str, sources: list[str], make) -> DataFrame:
    """What ``make()`` gives, written once for the files that ``sources`` hold now; made anew when one of them has changed."""
    files = []
    for s in sources:
        at = spark._jvm.org.apache.hadoop.fs.Path(s)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files += [(f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in (fs.listStatus(at) if fs.exists(at) else [])]
    key = (spark.sparkContext.applicationId, name, *sources)
    if key not in _KEPT or _KEPT[key][0] != files:
        _KEPT[key] = (files, materialize(make(), name))
    return _KEPT[key][1]


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "bucketed") -> DataFrame:
    """Write ``df`` bucketed by ``keys`` to the shared scratch folder; joins on them then need no exchange of it."""
    spark = df.sparkSession
    table = f"gq_{name}_{uuid.uuid4().hex}"
    path = f"{_folder(spark)}/{table}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
