"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id.  A document is
parsed greedily in factors: the longest stretches of words that stand at one place of
the reference.  A factor of at least WINDOW words is a duplicate span.  Where a factor
ends, the windows over its end are looked up too, so that a stretch which goes on in
another reference document is not lost to the greedy cut.

Indexing every window of every document would shuffle several times the texts.  So
the index grows in two steps.  A window's anchor, the least hash of the six-word
shingles inside it, is the same wherever the window stands; consecutive windows mostly
share theirs.  Blocks of the reference are the windows of one anchor: only anchors that
two documents have are worth indexing, and only their windows get entries (anchor and
hash, 128 bits; first document, place in it).  All sums are by key with partial aggregation, the joins
have one row a key on one side, and copies of a text take part once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomwork.llm.shingles import mixed
from loomwork.sized import join_small
from loomwork.storage import checkpointed, written

#: Words of the shortest factor that counts, and of an anchor's shingle.
WINDOW, SHINGLE = 13, 6
#: Rows of a batch that tasks give back, about.
BATCH = 2**17

_rng = np.random.default_rng(53013)
_PLACES = _rng.integers(1, 2**63, (3, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """The words of a text, unchanged: what stands between spaces and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _rolled(hashes: np.ndarray, width: int, which: int) -> np.ndarray:
    """A hash for each run of so many words."""
    n = len(hashes) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _PLACES[which, k]
    return mixed(total)


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def anchors(hashes: np.ndarray, window: int = WINDOW, shingle: int = SHINGLE) -> np.ndarray:
    """The anchor of each window of a document with so many words at least, as signed integers."""
    least = _rolled(hashes, shingle, 0).view(np.int64)
    left, span = window - shingle, 1
    while left:  # least of twice as many, as far as that goes
        step = min(span, left)
        least = np.minimum(least[:-step], least[step:])
        left, span = left - step, span + step
    return least


_ANCHORS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("name", pa.binary()), ("anchors", pa.list_(pa.int64()))])


def _anchored(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each document; none for one that has no window."""
    for batch in batches:
        found, ends = [], [0]
        for text in batch.column("text").to_pylist():
            parts = words(text)
            if len(parts) >= window:
                found.append(np.unique(anchors(_hashes(parts), window, shingle)))
            ends.append(ends[-1] + (len(found[-1]) if len(parts) >= window else 0))
        values = np.concatenate(found) if found else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), batch.column("name").cast(pa.binary()), lists], schema=_ANCHORS)


_ENTRIES = pa.schema([(c, pa.int64()) for c in ("anchor", "hash", "doc_id", "spot")])


def _windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """The windows with a shared anchor.

    A spot is, from the high bits, a window's place, whether it is the first of the
    document with its words, and the row's tag.
    """
    for batch in batches:
        held, n = [], 0
        for doc_id, tag, text, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text", "shared")), strict=True):
            hashes = _hashes(words(text))
            if len(hashes) < window:  # the doc_id came twice
                continue
            anchor = anchors(hashes, window, shingle)
            at = np.flatnonzero(np.isin(anchor, np.array(shared, np.int64)))
            found = _rolled(hashes, window, 1)[at].view(np.int64)
            fresh = np.zeros(len(at), np.int64)
            fresh[np.unique(found, return_index=True)[1]] = 1
            held.append((anchor[at], found, np.full(len(at), doc_id, np.int64), at << 33 | fresh << 32 | tag))
            n += len(at)
            if n >= BATCH:
                yield _entries(held)
                held, n = [], 0
        if held:
            yield _entries(held)


def _entries(held: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=_ENTRIES)


def factors(pos: np.ndarray, first: np.ndarray, ref: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """start, length, reference document and place there of the greedy factors of at least a window.

    Given are the windows of a document that the reference has, ascending, with the
    first place of each.  A factor goes on while the next window stands at the next
    place; at its end every window that begins inside it is looked at, so factors
    may overlap.
    """
    if not len(pos):
        return []
    cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(first) != 0) | (np.diff(ref) != 1)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]]) - 1
    return [(int(pos[a]), int(pos[b] - pos[a]) + window, int(first[a]), int(ref[a])) for a, b in zip(starts, ends, strict=True)]


_FACTORS = "array<struct<start:int,length:int,reference:bigint,place:int>>"
_FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("reference", pa.int64()), ("place", pa.int32())]))
_MARKED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("factors", _FACTOR)])
_PARSED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", _FACTOR)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _factored(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The factors of each document, of its windows that the reference has."""
    for batch in batches:
        out = []
        for doc_id, tag, found in zip(*(batch.column(c) for c in ("doc_id", "tag", "found")), strict=True):
            parts = found.values.flatten()
            rows = np.unique(np.stack([p.to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], axis=1), axis=0)  # a row that comes twice has each twice
            out.append((doc_id.as_py(), tag.as_py(), [dict(zip(("start", "length", "reference", "place"), f, strict=True)) for f in factors(*rows.T, window)]))
        yield _batch(out, _MARKED)


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, copy_of, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy_of", "factors")), strict=True):
            parts = words(text)
            spans = found or []
            if copy_of is not None and len(parts) >= window:
                spans = [{"start": 0, "length": len(parts), "reference": copy_of, "place": 0}]
            stays = np.ones(len(parts), bool)
            for f in spans:
                stays[f["start"] : f["start"] + f["length"]] = False
            kept = b" ".join(p for p, s in zip(parts, stays, strict=True) if s).decode("utf-8", "surrogatepass")
            out.append((doc_id, len(parts), int((~stays).sum()), kept, spans))
        yield _batch(out, _PARSED)


def without_repeats(documents: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by spaces) and factors of every row.

    Removed is each word in a run of `window` words that also stands in a document with
    a smaller doc_id, as the documents are given.  A null text has no words.  A row
    without doc_id takes no part: nothing is removed from it and it is no reference.
    Rows of one doc_id don't repeat each other; repeated rows give repeated rows.  Other
    columns are not read.  An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(2**32 - 1)))  # tells rows of one doc_id apart
    named = docs.where("doc_id IS NOT NULL").withColumn("name", F.unhex(F.sha2("text", 256)))
    found = written(named.mapInArrow(partial(_anchored, window=window, shingle=shingle), "doc_id long, tag long, name binary, anchors array<long>"), "anchors")
    found = found.where(F.size("anchors") > 0)
    groups = checkpointed(found.groupBy("name").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("last")).where("copy_of < last").drop("last"))
    copies = join_small(found.select("doc_id", "tag", "name"), groups, "name").where("doc_id > copy_of").select("doc_id", "tag", "copy_of").distinct()
    each = join_small(found, groups, "name", "left").where("copy_of IS NULL OR doc_id = copy_of").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").count().where("count > 1").select("anchor")  # a document has an anchor once
    lists = each.join(written(shared, "shared"), "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    rows = docs.join(written(lists, "lists"), "doc_id")
    entries = written(rows.mapInArrow(partial(_windows, window=window, shingle=shingle), "anchor long, hash long, doc_id long, spot long"), "entries")
    place = F.expr("CAST(min_by(spot >> 33, doc_id) FILTER (WHERE (spot >> 32) % 2 = 1) AS int)")
    index = entries.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), place.alias("ref"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    hits = entries.join(written(index, "index"), ["anchor", "hash"]).where("doc_id > first")
    hits = hits.groupBy("doc_id", F.col("spot").bitwiseAND(F.lit(2**32 - 1)).alias("tag")).agg(F.collect_list(F.struct(F.expr("CAST(spot >> 33 AS int)").alias("pos"), "first", "ref")).alias("found"))
    marks = hits.mapInArrow(partial(_factored, window=window), f"doc_id long, tag long, factors {_FACTORS}").withColumn("copy_of", F.lit(None).cast("long"))
    marks = written(marks.unionByName(copies, allowMissingColumns=True), "marks")
    rows = docs.join(marks, ["doc_id", "tag"], "left")
    return rows.mapInArrow(partial(_parsed, window=window), f"doc_id long, n_words long, n_removed long, kept string, factors {_FACTORS}")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and the hash of what stays, of without_repeats."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS parts FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(parts[i:i + {WINDOW - 1}], ' ') AS run FROM (SELECT doc_id, parts, unnest(range(1, len(parts) - {WINDOW - 2})) AS i FROM split)
), firsts AS (SELECT run, min(doc_id) AS least FROM windows GROUP BY run),
hit AS (SELECT doc_id, list(i) AS starts FROM windows JOIN firsts USING (run) WHERE least < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT s + k) AS places FROM (SELECT doc_id, unnest(starts) AS s FROM hit), range({WINDOW}) AS r(k) GROUP BY doc_id),
stay AS (
  SELECT s.doc_id, len(parts)::BIGINT AS n_words, [parts[i] FOR i IN list_sort(list_filter(range(1, len(parts) + 1), lambda x: NOT list_contains(coalesce(places, []), x)))] AS kept
  FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id
)
SELECT doc_id, n_words, n_words - len(kept)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM stay
"""
