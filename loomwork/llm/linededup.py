"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import checkpointed

RATIO = 0.02
MIN_PAGES = 5
#: Boilerplate lines of all hosts that are sent to every task; with more, documents and hosts are shuffled, a host in parts of so many bytes of texts.
BROADCAST_LINES, PART_BYTES = 200_000, 64 * 2**20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _name(line: Column) -> Column:
    """Lines are the same if they are equal without the spaces around them."""
    return F.xxhash64(F.trim(line))


def boilerplate(documents: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (hash), n_pages, host_pages of the lines that stand in more than that share of a host's pages.

    Copies are one page: a host's pages are its distinct texts.  A page counts a line
    once.  Lines of white space only and rows without a text count for nothing; a
    null host is a host of its own.
    """
    pages = documents.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    pages = pages.where("text IS NOT NULL").withColumn("page", F.xxhash64("text"))
    lines = F.filter(_lines(F.col("text")), lambda x: F.length(F.trim(x)) > 0)
    each = pages.select("host", "page", F.explode(F.array_distinct(F.transform(lines, _name))).alias("line"))
    often = each.groupBy("host", "line").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.countDistinct("page").alias("host_pages")).withColumnRenamed("host", "of_host")
    joined = often.join(totals, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    return joined.where(F.col("n_pages") > ratio * F.col("host_pages"))


def without_boilerplate(
    documents: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, added: bool = False
) -> DataFrame:
    """documents with text less the boilerplate lines of each row's host; added: also n_lines and n_dropped.

    A page that has only boilerplate lines gets an empty text (or its blank lines).
    Equal texts of a host are one page, so copies of a page don't make its lines
    boilerplate; near copies do, if they are more than that share.  A null text stays
    null, an empty one empty.  Other columns stay as they are, whatever their names
    (added columns replace those of their names).  An empty table gives an empty result.
    """
    found = checkpointed(boilerplate(documents, host, ratio, min_pages))
    by_host = found.groupBy("host").agg(F.collect_list("line").alias("frame"))  # at most (lines of a page / ratio) lines a host
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(host).cast("string").alias("of_host"))
    same = F.col("of_host").eqNullSafe(F.col("host"))
    if found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(by_host), same, "left")
    else:  # a host's documents go to as many tasks as they have parts, each with the host's lines
        key = lambda c: F.to_json(F.struct(F.col(c).alias("of")))  # noqa: E731  (a null host is one too)
        sizes = rows.groupBy(key("of_host").alias("key")).agg(F.sum(F.octet_length(F.col("row.text").cast("string"))).alias("size"))
        parts = F.greatest(F.ceil(F.col("size") / PART_BYTES), F.lit(1)).cast("int")
        hosts = checkpointed(by_host.withColumn("key", key("host")).join(sizes, "key").select("key", "host", "frame", F.coalesce(parts, F.lit(1)).alias("parts")))
        framed = hosts.select("key", "host", "frame", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        rows = join_small(rows.withColumn("key", key("of_host")), hosts.select("key", "parts"), "key", "left")
        part = F.pmod(F.xxhash64(F.col("row.text").cast("string")), F.coalesce("parts", F.lit(1))).cast("int")
        rows = rows.withColumn("part", part).join(framed, ["key", "part"], "left")
    text = F.col("row.text").cast("string")
    lines = _lines(text)
    met = F.array_intersect(F.transform(lines, _name), "frame")  # the page's own boilerplate lines, few
    rows = rows.select("row", F.when(F.col("frame").isNotNull(), met).alias("met"))
    kept = F.filter(lines, lambda x: ~F.array_contains("met", _name(x)) | (F.length(F.trim(x)) == 0))
    cut = F.coalesce(F.size("met") > 0, F.lit(False)) & (F.size(kept) < F.size(lines))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    extra = {"n_lines": n, "n_dropped": F.when(cut, F.size(lines) - F.size(kept)).otherwise(0).cast("long")} if added else {}
    new = F.when(cut, F.array_join(kept, "\n")).otherwise(text)
    columns = [(new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in documents.columns if c not in extra]
    return rows.select(F.struct(*columns, *[v.alias(c) for c, v in extra.items()]).alias("out")).select("out.*")


ORACLE = f"""
WITH pages AS (SELECT DISTINCT source, text FROM {{documents}} WHERE text IS NOT NULL), lines AS (
  SELECT DISTINCT text, source, trim(line, ' ') AS line
  FROM (SELECT text, source, unnest(string_split(text, chr(10))) AS line FROM pages)
  WHERE length(trim(line, ' ')) > 0
), often AS (
  SELECT source, line, count(*) AS n FROM lines GROUP BY source, line HAVING count(*) >= {MIN_PAGES}
), hosts AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
frame AS (
  SELECT often.source, list(line) AS lines FROM often JOIN hosts ON often.source IS NOT DISTINCT FROM hosts.source
  WHERE n > {RATIO} * total GROUP BY often.source
), cut AS (
  SELECT d.*, string_split(d.text, chr(10)) AS every,
    [x FOR x IN string_split(d.text, chr(10)) IF length(trim(x, ' ')) = 0 OR NOT list_contains(coalesce(f.lines, []), trim(x, ' '))] AS kept
  FROM {{documents}} d LEFT JOIN frame f ON d.source IS NOT DISTINCT FROM f.source
), decided AS (SELECT *, len(kept) < len(every) AS less FROM cut)
"""
