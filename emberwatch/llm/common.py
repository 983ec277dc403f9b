"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in spark.checkpoint.dir. Only where that is unset and all of Spark is one process
    (as in tests) a temporary folder is made; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberwatch-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: As many rows of keys are broadcast at most; more are joined by sorting.
FEW = 20_000


def sorted_in(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting whatever its size seems to be: a broadcast passes through the driver, and many of a plan do so at once."""
    return df.hint("merge")


def few(df: DataFrame) -> DataFrame:
    """df, which has been cut, to be broadcast in joins if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else sorted_in(df)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z for a search for ASCII words. lower() also maps other letters, which can't make
    or break such a word, but for the Kelvin sign, which it turns into an ASCII k."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.contains(text, F.lit("K")), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def per_worker(name: str, make):
    """make(), once per Python process; functions sent by value keep no module state from task to task."""
    store = vars(sys).setdefault("_emberwatch", {})
    if name not in store:
        store[name] = make()
    return store[name]
