"""Tables that must not be computed again, in a folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Where it is unset: on one machine a
    temporary folder, which the session then keeps; a cluster must name one that all its
    machines share, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def local_path(folder: str) -> str:
    """A folder's path for Python's own file functions: a mounted one, not an object store's address."""
    scheme, _, rest = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"not a mounted folder: {folder}")
    return "/" + rest.lstrip("/") if scheme else folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: all who read it see the
    same rows, and a lost executor takes none along."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
