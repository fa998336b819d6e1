"""Joins by rule: routes, hosts, enclosing ranges and shared shingles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import checkpointed

#: Readers whose routes are told apart, at most (one for each language of a project).
MOST_READERS = 1000


def _suffixes(host: Column) -> Column:
    """A host's own name and the patterns *.suffix that fit it."""
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.concat(F.lit("*."), F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    return F.array_distinct(F.concat(F.array(host), tails))


def by_host(rows: DataFrame, catalogue: DataFrame, key: str, host: str) -> DataFrame:
    """Rows with the service of their host: an exact pattern before a suffix, a longer suffix before a shorter one.

    A host is taken apart into all patterns that could fit, so the join has equal keys.
    """
    each = rows.select(key, host, F.posexplode_outer(_suffixes(F.col(host))).alias("place", "pattern"))
    met = join_small(each, catalogue, "pattern", "left")
    return met.groupBy(key, host).agg(F.min_by("service", F.when(F.col("service").isNotNull(), F.col("place"))).alias("service"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def route_trie(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefix tree of routes as rows: its steps (node, segment, child) and its ends (node, route_id, route_method, rest, cost).

    A node is the prefix that leads to it, with ":" for any parameter.  A last :name*
    ends its route at the node before it, where all that follows fits.
    """
    parts = F.transform(_segments(F.col("path")), lambda s: F.when(s.rlike(r"^:.*\*$"), "*").when(s.startswith(":"), ":").otherwise(s))
    shape = routes.select("route_id", F.col("method").alias("route_method"), parts.alias("parts"))
    at = F.array_position("parts", "*").cast("int")
    shape = shape.select("route_id", "route_method", (at > 0).alias("rest"), F.when(at > 0, F.slice("parts", 1, F.greatest(at - 1, F.lit(0)))).otherwise(F.col("parts")).alias("fixed"))
    prefix = lambda k: F.array_join(F.slice("fixed", 1, k), "/")
    every = shape.where(F.size("fixed") > 0).select("fixed", F.explode(F.sequence(F.lit(0), F.size("fixed") - 1)).alias("k"))
    steps = every.select(prefix(F.col("k")).alias("node"), F.get("fixed", F.col("k")).alias("segment"), prefix(F.col("k") + 1).alias("child")).distinct()
    cost = F.size(F.filter("fixed", lambda s: s == ":")) + F.col("rest").cast("int")
    return steps, shape.select(prefix(F.size("fixed")).alias("node"), "route_id", "route_method", "rest", cost.alias("params"))


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """request_id, route_id, params: the routes that answer each request; of several the most specific, all ties.

    requests: request_id, method (null: any), path; routes: route_id, method (or ANY), path
    with :name for one segment and :name* for all that follow, also none.  Literal
    segments must be equal, and a request's :param fits a parameter only.  All requests
    walk the tree of routes a level at a time, so a common first segment pairs nothing:
    a request has a row for each node it can be at.
    """
    steps, ends = (checkpointed(x) for x in route_trie(routes))
    depth = steps.agg(F.max(F.size(F.split("child", "/")))).first()[0] or 0
    at = requests.select("request_id", "method", _segments(F.col("path")).alias("parts"), F.lit("").alias("node"), F.lit(0).alias("level"), F.lit(True).alias("walks"))
    for k in range(depth):
        here = F.get("parts", F.lit(k))
        onward = F.when(here == ":param", F.array(F.lit(":"))).otherwise(F.array(here, F.lit(":")))
        ways = F.when(F.col("walks") & (F.size("parts") > k), F.concat(F.array(F.lit(None).cast("string")), onward)).otherwise(F.array(F.lit(None).cast("string")))
        each = at.withColumn("segment", F.explode(ways))
        met = join_small(each, steps, ["node", "segment"], "left").where("segment IS NULL OR child IS NOT NULL")
        at = met.select("request_id", "method", "parts", F.coalesce("child", "node").alias("node"), F.when(F.col("child").isNotNull(), k + 1).otherwise(F.col("level")).alias("level"), F.col("child").isNotNull().alias("walks"))
        if k % 12 == 11:
            at = checkpointed(at)
    met = join_small(at, ends, "node").where(F.col("rest") | (F.col("level") == F.size("parts")))
    method = F.col("method").isNull() | (F.col("route_method") == F.col("method")) | (F.col("route_method") == "ANY")
    found = met.where(method).select("request_id", "route_id", "params")
    best = F.rank().over(Window.partitionBy("request_id").orderBy("params"))
    return found.withColumn("best", best).where("best = 1").select("request_id", "route_id", "params").distinct()


def answered_elsewhere(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """request_id, route_id, params, confidence: requests that no route of their own reader answers, with the routes of other readers that do.

    requests: request_id, reader, method, path; routes: route_id, reader, method, path.
    All ties are kept; without a known method an answer is only possible.  The tree is
    walked once for all readers: own answers and those of others part at its ends.
    """
    met = match_per_reader(requests, routes)
    own = met.where("reader = of_reader").select("request_id").distinct()
    other = met.where("reader <> of_reader").join(own, "request_id", "left_anti")
    best = F.rank().over(Window.partitionBy("request_id").orderBy("params"))
    found = other.withColumn("best", best).where("best = 1")
    return found.select("request_id", "route_id", "params", F.when(F.col("method").isNull(), "possible").otherwise("sure").alias("confidence")).distinct()


def match_per_reader(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """request_id, reader, method, route_id, of_reader, params: the most specific answers that each reader's routes give to each request."""
    readers = checkpointed(routes.select("route_id", F.col("reader").alias("of_reader")))
    # A request walks the tree of each reader's routes: the reader is its first segment.
    rooted = routes.select("route_id", "method", F.concat_ws("/", F.lit(""), F.concat(F.lit("reader "), F.col("reader").cast("string")), "path").alias("path"))
    known = [r[0] for r in routes.select(F.col("reader").cast("string")).distinct().limit(MOST_READERS + 1).collect()]
    if len(known) > MOST_READERS:
        raise ValueError(f"more than {MOST_READERS} readers")
    asked = requests.where("path IS NOT NULL").select("request_id", "reader", "method", "path", F.explode(F.array(*[F.lit(k) for k in known]) if known else F.array().cast("array<string>")).alias("by"))
    rows = asked.select(F.struct("request_id", "by").alias("request_id"), "method", F.concat_ws("/", F.lit(""), F.concat(F.lit("reader "), F.col("by")), "path").alias("path"))
    found = join_small(match_routes(rows, rooted).select("request_id.request_id", "route_id", "params"), readers, "route_id")
    return found.join(requests.select("request_id", "reader", "method"), "request_id")


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Each point with the range of its key that encloses it and starts last (then the smaller range_id): point_id, range_id, start.

    points: point_id, key, at; ranges: key, range_id, start, end; ids are numbers.  Of ranges with one
    start and end only the least range_id counts.  A range is dealt to bins of that
    width; in a bin, points and ranges are walked in order of place, with only the ranges
    that are still open in memory, so no point meets a range that doesn't enclose it but
    stands in the bin.  A busy key is dealt out by its bins.
    """
    one = ranges.where("start <= end").groupBy(key, "start", "end").agg(F.min("range_id").alias("range_id"))
    bins = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    none = F.lit(None)
    opened = one.select(
        F.col(key).alias("key"), F.explode(bins).alias("bin"), F.col("start").cast("double").alias("at"), F.lit(0).alias("is_point"), F.col("end").cast("double").alias("end"),
        F.col("range_id").cast("long").alias("id"),
    )
    asked = points.where(F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.floor(F.col(at) / width).alias("bin"), F.col(at).cast("double").alias("at"), F.lit(1).alias("is_point"), none.cast("double").alias("end"),
        F.col("point_id").cast("long").alias("id"),
    )
    dealt = opened.unionByName(asked).repartition("key", "bin").sortWithinPartitions("key", "bin", "at", "is_point", F.desc("id"))
    found = dealt.mapInArrow(_walk_ranges, "point_id long, range_id long, start double")
    best = F.max(F.struct("start", (-F.col("range_id")).alias("id")))  # of a point_id that comes twice
    return found.groupBy("point_id").agg(best.alias("b")).select("point_id", (-F.col("b.id")).alias("range_id"), "b.start")


def _walk_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in order, ranges before points and of one start the least id last, give each point's innermost range.

    The open ranges are a stack: one that ends no later than another that starts later
    (or at the same place, with a smaller id) can never be the answer again and goes.
    """
    at_key, stack = None, []
    schema = pa.schema([("point_id", pa.int64()), ("range_id", pa.int64()), ("start", pa.float64())])
    for batch in batches:
        points, found, starts = [], [], []
        for key, bin_, at, is_point, end, id_ in zip(*(batch.column(c).to_pylist() for c in ("key", "bin", "at", "is_point", "end", "id")), strict=True):
            if (key, bin_) != at_key:
                at_key, stack = (key, bin_), []
            if is_point:
                while stack and stack[-1][0] < at:
                    stack.pop()
                if stack:
                    points.append(id_)
                    found.append(stack[-1][2])
                    starts.append(stack[-1][1])
            else:
                while stack and stack[-1][0] <= end:
                    stack.pop()
                stack.append((end, at, id_))
        yield pa.record_batch([pa.array(points, pa.int64()), pa.array(found, pa.int64()), pa.array(starts, pa.float64())], schema=schema)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def shingles(text: Column, n: int, hashed: bool = False) -> Column:
    """The distinct runs of n words of letters and digits, in lower case; hashed: as 64-bit hashes, without building the runs."""
    def runs(w: Column) -> Column:
        one = lambda i: F.xxhash64(F.slice(w, i, n)) if hashed else F.array_join(F.slice(w, i, n), " ")
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), one)
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>" if hashed else "array<string>"))

    # a lambda's argument is computed once, where a repeated expression would be computed for each run
    return F.get(F.transform(F.array(_words(text)), runs), F.lit(0))


def shared_shingles(documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, n: int) -> DataFrame:
    """Documents that share runs of n words with reference items: how many, and with how many items.

    Hashes of the runs meet first; only documents with a hash in common are read again
    and compared run by run.
    """
    hashes = checkpointed(items.select(F.explode(shingles(F.col("text"), n, hashed=True)).alias("h")).distinct())
    each = documents.select(doc_id, F.explode(shingles(F.col("text"), n, hashed=True)).alias("h"))
    likely = checkpointed(join_small(each, hashes, "h", "left_semi").select(doc_id).distinct())
    have = join_small(documents.select(doc_id, "text"), likely, doc_id, "left_semi").select(doc_id, F.explode(shingles(F.col("text"), n)).alias("g"))
    want = items.select(item_id, F.explode(shingles(F.col("text"), n)).alias("g")).distinct()
    met = join_small(have, checkpointed(want), "g")
    return met.groupBy(doc_id).agg(F.countDistinct("g").alias("shared"), F.countDistinct(item_id).alias("items"))
