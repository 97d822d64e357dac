"""Tables that a plan writes on the way, so that what is dear is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications that name none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lithos-")
    return _LOCAL[app]


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again.

    Lineage ends there, so a lost executor costs a read.  The table stays, since
    what is returned reads it; whoever owns the folder deletes it.
    """
    path = f"{shared_folder(rows.sparkSession)}/lithos-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
