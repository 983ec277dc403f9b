"""Numbered lines of text files of any size, and the last lines of files, read by byte ranges."""

from __future__ import annotations

from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..functions.text import stripped

#: Rows of the table of ranges up to which it is broadcast: a row per range of some 128 MB.
MOST_RANGES = 100_000
#: Bytes of a tail.
TAIL = 1 << 20


def numbered_lines(spark: SparkSession, path: str, *, blank: bool = False) -> DataFrame:
    """file, idx, raw: the lines of each file, trimmed, numbered from 0; lines that are blank are left out.

    blank: every line as it is, blank ones counted. Spark cuts files that aren't compressed into ranges of
    spark.sql.files.maxPartitionBytes, which different tasks read; within a range its rows keep their order, so a line's number is
    its place in its range and the lines of the ranges before. The lines are read once and kept in the shared
    folder, so that counts and places come from the same ranges. Lines end with \\n, \\r or both.
    """
    said = F.col("value") if blank else stripped(F.col("value"))
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__range"), said.alias("raw"))
    own = own if blank else own.filter(F.length("raw") > 0)
    own = kept(own.select("*", F.monotonically_increasing_id().alias("__place")))
    # counts of ranges are rows per 128 MB; only they are put in order
    ranges = own.groupBy("file", "__range").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = kept(ranges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    few = ranges.count() <= MOST_RANGES
    joined = own.join(F.broadcast(ranges) if few else ranges, ["file", "__range"])
    return joined.select("file", (F.col("__before") + F.col("__place") - F.col("__first")).alias("idx"), "raw")


def tail_lines(spark: SparkSession, path: str, most: int = TAIL) -> DataFrame:
    """file, line, raw of the last lines of a file or folder, oldest first; line counts within what is read.

    The newest files (by time of change, then name) are taken up to `most` bytes in all, and of the oldest of them only its end, from
    the first line that begins there. These bytes, and no others, are read, by the driver: they are bounded by `most`.
    Blank lines are left out; bytes that are no UTF-8 are replaced. Hidden files (. and _) don't count.
    """
    if most <= 0:
        raise PySparkValueError("most has to be positive")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(root) if f.isFile() and (f.getPath().getName()[0] not in "._" or f.getPath().getName() == root.getName())]
    left, found = most, []
    for f in sorted(files, key=lambda f: (f.getModificationTime(), f.getPath().getName()), reverse=True):
        size = min(f.getLen(), left)
        if size:
            found.append((str(f.getPath()), _end(spark, fs, f, size)))
            left -= size
    rows = [(name, i, line.strip()) for name, text in reversed(found) for i, line in enumerate(text.splitlines()) if line.strip()]
    return spark.createDataFrame(rows, "file string, line int, raw string")


def _end(spark: SparkSession, fs, file, size: int) -> str:
    start = file.getLen() - size
    stream = fs.open(file.getPath())
    try:
        stream.seek(max(start - 1, 0))
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size + (start > 0)))
    finally:
        stream.close()
    if start > 0:  # with the byte before, so that a line that begins right here is whole
        ends = [at for at in (data.find(b"\n"), data.find(b"\r")) if at >= 0]
        data = data[min(ends) + 1 :] if ends else b""
    return data.decode("utf-8", errors="replace")
