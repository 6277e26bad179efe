"""Which loads a partitioned table holds: a small file per load name says in which folder its rows are.

Rows of a load are written under a folder name of their own first; nothing reads them until the load's file in the ledger is put in place by one
rename, which also takes the place of an earlier load of the name. So a writer that is lost at any point leaves the old or the new load, never
neither or both, and any text may name a load, as names are data here and never part of a path.
"""

import json
import time
import uuid
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "load string, folder string"


def ledger_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/loads/{table}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def entry_path(root: str, table: str, load: str) -> str:
    return f"{ledger_path(root, table)}/{sha256(load.encode()).hexdigest()}.json"


def publish(spark: SparkSession, root: str, table: str, folders: dict[str, str]) -> None:
    """Make ``folders`` what the loads of these names are, one rename each."""
    files = _files(spark, ledger_path(root, table))
    files.mkdirs(_path(spark, ledger_path(root, table)))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    for load, folder in folders.items():
        draft = _path(spark, f"{ledger_path(root, table)}/.{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps({"load": load, "folder": folder}).encode()))
        out.close()
        context.rename(files.makeQualified(draft), files.makeQualified(_path(spark, entry_path(root, table, load))), over)


def withdraw(spark: SparkSession, root: str, table: str, loads: list[str]) -> None:
    """Take loads of these names out of the table; names it doesn't hold are passed over."""
    files = _files(spark, ledger_path(root, table))
    for load in loads:
        files.delete(_path(spark, entry_path(root, table, load)), False)


def entries(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """(load, folder) of a table, or None where it has never had a ledger."""
    path = ledger_path(root, table)
    return spark.read.schema(ENTRY).json(path) if _files(spark, path).exists(_path(spark, path)) else None


def listed(rows: DataFrame, root: str, table: str, column: str) -> DataFrame:
    """Those of ``rows`` whose folder, in the partition column ``column``, is in the ledger."""
    known = entries(rows.sparkSession, root, table)
    return rows if known is None else rows.join(known.select(F.col("folder").alias(column)), column, "left_semi")


def sweep(spark: SparkSession, root: str, table: str, table_path: str, column: str, older_than: float = 86_400) -> int:
    """Delete folders that no load names any more and say how many. Younger ones may belong to a writer still at work, or a reader."""
    files, known = _files(spark, table_path), entries(spark, root, table)
    if known is None:
        return 0
    kept, gone = {r["folder"] for r in known.collect()}, 0  # one short name a load
    for found in files.globStatus(_path(spark, f"{table_path}/*=*/{column}=*")) or []:
        if found.getPath().getName().split("=", 1)[1] not in kept and time.time() - found.getModificationTime() / 1000 >= older_than:
            gone += files.delete(found.getPath(), True)
    return gone
