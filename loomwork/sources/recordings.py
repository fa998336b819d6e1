"""Recordings of events as JSON lines: batch and streaming readers, and where their rows go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.text import language, utf8

EVENT = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("process", T.StringType()), T.StructField("sequence", T.LongType()),
    T.StructField("timeNs", T.LongType()), T.StructField("type", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("parentId", T.StringType()), T.StructField("requestId", T.StringType()), T.StructField("durationNs", T.LongType()),
    T.StructField("error", T.BooleanType()), T.StructField("method", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("function", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("operation", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("sql", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("at", T.LongType()), T.StructField("host", T.StringType()), T.StructField("root", T.StringType()), T.StructField("node", T.StringType()),
])
#: Folders of a recording tree that hold none: other projects, tests and bundles.
SKIPPED = r"(^|/)(projetos|test-[^/]*|bundle-[^/]*)(/|$)"


def read(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The events below a path, with run (the folder) and file; lines that aren't JSON objects, and other versions, are left out."""
    rows = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return _placed(rows, version)


def follow(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The same as a stream: new files are read as they come; the checkpoint of the query keeps the place."""
    rows = spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return _placed(rows, version)


def _placed(rows: DataFrame, version: int) -> DataFrame:
    file = F.col("_metadata.file_path")
    placed = rows.withColumns({"file_path": file, "run": F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)})
    return placed.where((F.col("version") == version) & F.col("type").isNotNull() & ~F.col("file_path").rlike(SKIPPED))


def spool(spark: SparkSession, path: str, largest: int = 4 * 1024 * 1024) -> DataFrame:
    """Small files of a spool folder, oldest first by time, then name; larger ones are left out.

    Bytes that aren't UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= largest)
    return files.select("path", "modificationTime", utf8(F.col("content")).alias("text")).orderBy("modificationTime", "path")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, language, size, lines, hash of all files below a folder; build and environment folders are left out.

    Empty files are not there: Spark's readers pass them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    skipped = r"/(node_modules|\.git|dist|build|\.next|venv|\.venv|__pycache__)/"
    text = F.col("content").cast("string")  # not decoded: line breaks are counted in the bytes, and a file need not be text
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))
    lines = breaks + F.when((F.col("length") > 0) & (F.substring("content", -1, 1) != F.unhex(F.lit("0A"))), 1).otherwise(0)
    return files.where(~F.col("path").rlike(skipped)).select(
        "path", language(F.col("path")).alias("language"), F.col("length").alias("size"), lines.cast("long").alias("lines"), F.sha2("content", 256).alias("hash")
    )


def requests(events: DataFrame) -> DataFrame:
    """One row for each request: its start, with status and duration from its end where that has come."""
    start = events.where("type = 'request'").groupBy("run", "process", "requestId").agg(
        F.min_by(F.struct("method", "path", "at", "action", "host"), "sequence").alias("s")
    )
    end = events.where("type = 'request-end'").groupBy("run", "process", "requestId").agg(
        F.max_by(F.struct("status", "durationNs", F.col("sequence").alias("end_sequence")), "sequence").alias("e")
    )
    return start.join(end, ["run", "process", "requestId"], "left").select("run", "process", "requestId", "s.*", "e.*", F.col("e").isNotNull().alias("ended"))


def steps(events: DataFrame) -> DataFrame:
    """Functions and boundaries with their ends: duration, error, finished."""
    start = events.where("type IN ('enter', 'boundary')").select("requestId", "process", "sequence", "id", "parentId", "type", "function", "file", "line", "kind", "operation", "tables")
    end = events.where("type IN ('exit', 'boundary-end')").groupBy("id").agg(F.max_by(F.struct("durationNs", "error"), "sequence").alias("e"))
    return start.join(end, "id", "left").select(start["*"], F.col("e.durationNs").alias("durationNs"), F.coalesce("e.error", F.lit(False)).alias("error"), F.col("e").isNotNull().alias("finished"))


def common_folder(rows: DataFrame, by: str, path: str) -> DataFrame:
    """The folder that all paths of a group share, from the least and the greatest path: what those two share, all share."""
    ends = rows.groupBy(by).agg(F.split(F.min(path), "/").alias("a"), F.split(F.max(path), "/").alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda k: F.slice("a", F.lit(1), k) == F.slice("b", F.lit(1), k))
    shared = F.size(F.filter(same, lambda x: x))
    return ends.select(by, F.array_join(F.slice("a", F.lit(1), shared), "/").alias("folder"))


def unreferenced(objects: DataFrame, manifests: DataFrame, kept: DataFrame) -> DataFrame:
    """Objects that no kept moment's manifest names."""
    used = manifests.join(kept.select("moment_id"), "moment_id", "left_semi").select("hash")
    return objects.join(used, "hash", "left_anti")
