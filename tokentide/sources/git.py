"""Where a workspace's repository comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.sources import logs

#: Line in a section of the remote origin that names it, without '.git'.
_ORIGIN = r'(?s)(?:^|\n)\s*\[remote "origin"[^\n]*\]\s*(?:\n(?!\s*\[)[^\n]*)*?\n\s*url = ([^\n]*)'


def origin_urls(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """(folder_path, origin) of the distinct ``folder_path`` whose ``.git/config`` names a remote origin.

    The folders, one for each workspace, are listed by the driver, as any listing of files is.
    """
    names = [r["folder_path"] for r in folders.select("folder_path").filter("folder_path <> ''").distinct().collect()]
    there = logs.existing(spark, [f"{n.rstrip('/')}/.git/config" for n in names])
    files = logs.read_files(spark, there)
    url = F.regexp_replace(F.trim(F.regexp_extract("value", _ORIGIN, 1)), r"\.git$", "")
    below = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"/\.git/config$", "")
    found = files.select(below.alias("__folder"), url.alias("origin")).filter("origin <> ''")
    keyed = folders.select("folder_path").distinct()
    return keyed.join(found, F.rtrim("folder_path", F.lit("/")) == F.col("__folder")).select("folder_path", "origin")


def with_origins(spark: SparkSession, sessions: DataFrame) -> DataFrame:
    """SESSIONS whose empty ``git_remote_url`` is the origin of their folder's repository, if it has one."""
    found = sessions.join(origin_urls(spark, sessions), "folder_path", "left")
    url = F.when(F.col("git_remote_url") == "", F.coalesce("origin", F.lit(""))).otherwise(F.col("git_remote_url"))
    return found.withColumn("git_remote_url", url).select(sessions.columns)
