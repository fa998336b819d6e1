"""A store of contents by their hash, and moments: manifests of which path had which content.

An object is written once: contents whose hash is there already are left out before the
append.  Spark's commit protocol makes a retried or lost task leave no part behind; two
writers at one time may both append an object, which then stands there twice with equal
content, and readers take one.  A moment's id is made of its paths and contents, so the
same files give the same moment, which is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import text as fn
from loomwork.storage import written

#: Bytes of the largest content that is kept.
MOST_BYTES = 1024 * 1024
#: Parts in which a manifest is hashed before their hashes are.
PARTS = 4096
# Files of which only the names of variables are kept, and parts of paths that lead out of a folder.
ENV_FILE = r"(^|/)\.env[^/]*$"
_OUTSIDE = r"^/|(^|/)\.\.(/|$)"
OBJECT = T.StructType().add("hash", "string").add("content", "string").add("shard", "string")
ENTRY = T.StructType().add("path", "string").add("hash", "string").add("size", "long").add("flag", "string").add("real_hash", "string").add("moment", "string")


def manifest(files: DataFrame) -> DataFrame:
    """path, kept, hash, size, flag, real_hash of files (path, content): hash is of what is kept, real_hash of the file where the two differ.

    Of several rows of a path the least content counts; rows without a path or content go.
    Of a large file kept is null: its hash is of the whole.  Keys are looked for once, and only where a text may have one.
    """
    rows = files.where("path IS NOT NULL AND content IS NOT NULL").groupBy("path").agg(F.min(F.col("content").cast("string")).alias("content"))
    path, content = F.col("path"), F.col("content")
    env, large = path.rlike(ENV_FILE), F.octet_length(content) > MOST_BYTES
    names = F.array_join(F.transform(fn.env_names(content), lambda n: F.concat(n, F.lit("="))), "\n")
    masked = F.when(content.rlike(fn.MASKABLE), fn.mask_keys(content)).otherwise(content)
    each = rows.select("path", "content", F.when(env, "names").when(large, "large").alias("by_name"), F.when(env, names).when(~large, masked).alias("kept"), F.sha2("content", 256).alias("whole"))
    flag = F.coalesce("by_name", F.when(F.col("kept") != F.col("content"), "masked"))
    hashed = each.select("path", "kept", F.coalesce(F.sha2("kept", 256), "whole").alias("hash"), F.octet_length("content").cast("long").alias("size"), flag.alias("flag"), "whole")
    return hashed.select("path", "kept", "hash", "size", "flag", F.when(F.col("hash") != F.col("whole"), F.col("whole")).alias("real_hash"))


def moment_id(entries: DataFrame) -> str:
    """The id of a manifest: a hash of its paths and contents, part by part, whatever the order of its rows."""
    line = F.concat("path", F.lit("\0"), F.coalesce("real_hash", "hash"))
    parts = entries.groupBy(F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    every = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256)).first()[0]
    return f"m-{every[:16]}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a part of the archive, none if it isn't there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def archive(files: DataFrame, folder: str) -> tuple[str, int, int]:
    """Writes files (path, content) as a moment of an archive: its id, its files, and the objects that were new.

    Contents that are large are not kept, keys in code are masked, and of environment
    files only names are; the real hash of each stays with its entry.
    """
    spark = files.sparkSession
    rows = written(manifest(files), "manifest")
    found = moment_id(rows)
    wanted = rows.where("flag IS NULL OR flag <> 'large'").select("hash", F.col("kept").alias("content")).distinct()  # a hash has one content
    known = _read(spark, f"{folder}/objects", OBJECT).select("hash")
    new = written(wanted.join(known, "hash", "left_anti").withColumn("shard", F.substring("hash", 1, 2)), "objects")
    n_new = new.count()
    if n_new:  # an object is in the folder of its first two digits, so a look-up reads one folder
        new.repartition("shard").write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/objects")
    if _read(spark, f"{folder}/moments", ENTRY).where(F.col("moment") == found).isEmpty():
        rows.drop("kept").withColumn("moment", F.lit(found)).write.mode("append").option("compression", "zstd").partitionBy("moment").parquet(f"{folder}/moments")
    return found, rows.count(), n_new


def read_moment(spark: SparkSession, folder: str, moment: str) -> DataFrame:
    """path, hash, size, flag, real_hash of a moment's files; no rows if the moment isn't there."""
    rows = _read(spark, f"{folder}/moments", ENTRY).where(F.col("moment") == moment).drop("moment")
    return rows.dropDuplicates(["path"])  # of two writers of one moment


def materialized(spark: SparkSession, folder: str, moment: str) -> DataFrame:
    """path, content, state of a moment's files: content is null where it wasn't kept, and for paths that lead out of the folder."""
    entries = read_moment(spark, folder, moment).withColumn("shard", F.substring("hash", 1, 2))
    objects = _read(spark, f"{folder}/objects", OBJECT).dropDuplicates(["hash"])
    both = entries.join(objects, ["hash", "shard"], "left")
    outside, gone = F.col("path").rlike(_OUTSIDE), (F.col("flag") == "large") | F.col("content").isNull()
    state = F.when(outside, "outside").when(gone, "missing").otherwise(F.coalesce("flag", F.lit("whole")))
    return both.select("path", F.when(~outside & (F.coalesce("flag", F.lit("")) != "large"), F.col("content")).alias("content"), state.alias("state"))


def archived(spark: SparkSession, folder: str, hashes: DataFrame) -> DataFrame:
    """hash, content of the objects asked for (hash); those that aren't there give no row."""
    wanted = hashes.select("hash").where(F.col("hash").rlike("^[0-9a-f]{64}$")).distinct().withColumn("shard", F.substring("hash", 1, 2))
    return wanted.join(_read(spark, f"{folder}/objects", OBJECT), ["hash", "shard"]).dropDuplicates(["hash"]).select("hash", "content")
