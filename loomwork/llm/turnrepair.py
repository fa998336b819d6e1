"""Conversation structure repair by dynamic programming over turns and grammar states.

A backward pass gives the cheapest cost to go for each turn and state of the grammar
(nothing yet, after the system turn, after the user, after the assistant); a forward
walk then takes, of the edits that lie on a cheapest way, the ASCII-least.  One code
of a byte for each turn is all that the two passes need.

Turns are dealt out by range of (conversation, order), so that a task walks whole
conversations with their texts, and a large conversation or one that lies over the
end of a task's range is written as segments of bounded size.  Of those only the
codes come together, in the task that makes the conversation's audit (a cell of the
result that is as long); their texts are hashed in order, a segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import written

#: Costs of the edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: What Insert and Rerole lead to from each state, and the states where a conversation may end.
NEXT, ENDS = (2, 2, 3, 2), (0, 3)
#: States that Keep leads to, by state and initial of the role; other initials are not in the grammar.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
#: A code is the initial's place here, plus 4 for a turn that must go and 8 for one that is truncated.
INITIALS = "sua"
#: Turns and characters of a segment at most (a longer turn is a segment of its own).
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 2**20
#: Bytes of texts that a task gets.
TASK_BYTES = 32 * 2**20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of a table whose turns are damaged by crc32 of `conv_id:turn`.

    Null roles and texts are one space, and so are null ids inside the hash.  A
    dropped turn stays as a row without role and text, so that its conversation does.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    rows = rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("dropped"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_", "times")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Adds name (hash of the text), blank, truncated and first (the first turn of a role and text that comes more than once)."""
    rows = rows.withColumn("name", F.unhex(F.sha2("text", 256)))
    rows = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("truncated", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    known = rows.where("NOT dropped").groupBy("conv_id", "role", "name").agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.count_if(F.col("turn").isNull()).alias("nulls"))
    known = known.where("n > 1").select(
        F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("name").alias("of_name"), "least", (F.col("nulls") > 0).alias("at_null"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("name") == F.col("of_name"))
    joined = rows.join(known, same, "left")
    earlier = F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("least")))
    return joined.withColumn("earlier", F.coalesce(earlier, F.lit(False))).drop("of_conv", "of_role", "of_name", "least", "at_null")


def code(initial: str, blank: bool, duplicate: bool, truncated: bool) -> int:
    """The byte for one turn."""
    at = INITIALS.find(initial) if initial else -1
    return (at if at >= 0 else 3) + 4 * (blank or duplicate) + 8 * (truncated and not blank and not duplicate)


def _choices(codes: bytes) -> tuple[int, bytearray]:
    """The least cost, and the edit to take for each turn counted from the end, by state: four bytes a turn.

    Of the edits on a cheapest way that is the ASCII-least.  The first four are for
    the end, where Insert completes a conversation.
    """
    def with_inserts(at: list[int]) -> list[int]:
        one = [min(at[s], INSERT + at[NEXT[s]]) for s in range(4)]
        return [min(one[s], INSERT + one[NEXT[s]]) for s in range(4)]

    now = with_inserts([0 if s in ENDS else 10**9 for s in range(4)])
    out = bytearray(b" II ")
    for c in reversed(codes):
        stays = TRUNCATED if c & 8 else 0
        ways = [{"D": DELETE + v} for v in now]
        if not c & 4:
            initial = INITIALS[c & 3] if c & 3 < 3 else ""
            for s in range(4):
                if initial in KEEP[s]:
                    ways[s]["K"] = stays + now[KEEP[s][initial]]
                ways[s]["R"] = REROLE + stays + now[NEXT[s]]
        now = with_inserts([min(w.values()) for w in ways])
        for s in range(4):
            ways[s]["I"] = INSERT + now[NEXT[s]]
            out.append(ord(min(e for e, cost in ways[s].items() if cost == now[s])))
    return now[0], out


def _walk(codes: bytes) -> tuple[int, str]:
    cost, choices = _choices(codes)
    state, at, audit = 0, 0, bytearray()
    while (edit := chr(choices[4 * (len(codes) - at) + state])) != " ":
        audit += edit.encode()
        if edit == "K":
            state = KEEP[state][INITIALS[codes[at] & 3]]
        elif edit != "D":
            state = NEXT[state]
        at += edit != "I"
    return cost, audit.decode()


_short = lru_cache(maxsize=50_000)(_walk)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the turns with those codes: the ASCII-least of the cheapest edits' initials."""
    return _short(codes) if len(codes) <= 64 else _walk(codes)


def rebuilt(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The turns that the edits leave of roles and texts, beginning in a state, and the state they end in."""
    out, at = [], 0
    for edit in audit:
        if edit == "K":
            state = KEEP[state][roles[at][:1]]
            out.append((roles[at], texts[at]))
        elif edit != "D":
            state = NEXT[state]
            out.append((ROLE[state], texts[at] if edit == "R" else ""))
        at += edit != "I"
    return out, state


class _Segment:
    """Consecutive turns of one conversation."""

    def __init__(self, conv_id: int | None, number: int) -> None:
        self.conv_id, self.number = conv_id, number
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.distinct = 0
        self.first = self.last = None  # turns that aren't null
        self.head = self.tail = None  # (turn, role, name) of the ends
        self.head_blank = self.head_truncated = False

    def full(self, text: str, most_rows: int) -> bool:
        return bool(self.texts) and (len(self.texts) >= most_rows or self.chars + len(text) > SEGMENT_CHARS)

    def add(self, turn: int | None, role: str, text: str, name: bytes, blank: bool, truncated: bool, earlier: bool, same: bool) -> None:
        duplicate = not blank and (earlier or same)
        self.codes.append(code(role[:1], blank, duplicate, truncated))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated and not blank and not duplicate
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.tail = (turn, role, name)
        self.head = self.head or self.tail


_SEGMENT = (
    "conv_id long, number long, whole boolean, codes binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, n_turns long, "
    "first long, last long, head string, tail string, cost long, audit string, illegal long, sha string"
)
_WHOLE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PIECE = _WHOLE + ", number long, piece string, state int"
_HASH = "of_conv long, repaired_sha256 string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _key(of: tuple[int | None, str, bytes] | None) -> str | None:
    return None if of is None else f"{'' if of[0] is None else of[0]}:{of[2].hex()}:{of[1]}"


def illegal(codes: bytes) -> int:
    """Adjacent initials that the grammar doesn't have."""
    return sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:], strict=False))


def _joined_turns(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


_READ = ("conv_id", "turn", "role", "text", "dropped", "name", "blank", "truncated", "earlier", "part")


def _segments(batches: Iterator[pa.RecordBatch], most_rows: int = SEGMENT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows in order give a repaired row for each conversation that is one segment inside the task, else its segments."""
    def row(s: _Segment, whole: bool) -> tuple:
        cost = audit = wrong = sha = None
        if whole:
            cost, audit = repair(bytes(s.codes))
            wrong = illegal(s.codes)
            sha = hashlib.sha256(_joined_turns(rebuilt(audit, 0, s.roles, s.texts)[0])).hexdigest()
        kept = (None, None, None) if whole else (bytes(s.codes), s.roles, s.texts)
        return (s.conv_id, s.number, whole, *kept, s.blank, s.duplicate, s.truncated, s.distinct, s.first, s.last, _key(s.head), _key(s.tail), cost, audit, wrong, sha)

    now: _Segment | None = None
    alone, number = False, 0  # whether the conversation began inside this task and is one segment yet; segments so far
    for batch in batches:
        out = []
        for conv, turn, role, text, dropped, name, blank, truncated, earlier, part in zip(*(batch.column(c).to_pylist() for c in _READ), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    out.append(row(now, alone))
                alone, now, number = now is not None, _Segment(conv, (part << 32) + number), number + 1
            if dropped:
                continue
            same = now.tail == (turn, role, name)
            if now.full(text, most_rows):
                out.append(row(now, False))
                alone, now, number = False, _Segment(conv, (part << 32) + number), number + 1
            now.add(turn, role, text, name, blank, truncated, earlier, same)
        yield _batch(out, _SEGMENT)
    if now is not None:
        yield _batch([row(now, False)], _SEGMENT)


def _joined(group: pa.Table) -> pa.Table:
    """All segments of one conversation, without texts: its row, on the first of them, and each segment's edits."""
    parts, codes, tail = [], bytearray(), None
    blank, duplicate, truncated, n_turns, first, last = 0, 0, 0, 0, None, None
    for s in group.sort_by("number").to_pylist():
        mine = bytearray(s["codes"])
        blank, duplicate, truncated, n_turns = blank + s["blank"], duplicate + s["duplicate"], truncated + s["truncated"], n_turns + s["n_turns"]
        if mine and s["head"] == tail and not mine[0] & 4:  # equal to the last turn of a segment of another task
            truncated -= bool(mine[0] & 8)
            duplicate += 1
            mine[0] = mine[0] & 3 | 4
        parts.append((s["number"], len(mine)))
        codes += mine
        tail = s["tail"] if mine else tail
        if s["first"] is not None:
            n_turns -= s["first"] == last
            first, last = s["first"] if first is None else first, s["last"]
    cost, audit = repair(bytes(codes))
    gaps = 0 if first is None else last - first + 1 - n_turns
    conv = group.column("conv_id")[0].as_py()
    whole = (conv, gaps, blank, duplicate, truncated, illegal(codes), cost, audit)
    out, at, turn, state, end = [], 0, 0, 0, 0
    for k, (number, n) in enumerate(parts):
        begin, entered, end = at, state, end + n
        while at < len(audit) and (turn < end or k + 1 == len(parts)):
            edit = audit[at]
            if edit == "K":
                state = KEEP[state][INITIALS[codes[turn] & 3]]
            elif edit != "D":
                state = NEXT[state]
            turn += edit != "I"
            at += 1
        out.append((*(whole if k == 0 else (conv, *[None] * 7)), number, audit[begin:at], entered))
    return pa.Table.from_batches([_batch(out, _PIECE)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order, with their edits: the hash of each conversation's repaired turns."""
    key, held, begun, opened = None, hashlib.sha256(), False, False
    for batch in batches:
        out = []
        for conv, roles, texts, piece, state in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts", "piece", "state")), strict=True):
            if opened and conv != key:
                out.append((key, held.hexdigest()))
            if not opened or conv != key:
                key, held, begun, opened = conv, hashlib.sha256(), False, True
            turns = rebuilt(piece, state, roles, texts)[0]
            if turns:
                held.update(b"\n" * begun + _joined_turns(turns))
                begun = True
        yield _batch(out, _HASH)
    if opened:
        yield _batch([(key, held.hexdigest())], _HASH)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of a table like damaged's.

    Turns go by number, nulls first; turns of one number by role and then by the hash
    of the text, so that equal ones stand together.  A null conv_id is a conversation
    of its own.  A conversation whose rows are all dropped gives zeros, an empty
    audit and the hash of nothing.  An empty table gives an empty result.
    """
    rows = _with_faults(turns)
    size = turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("conv_id").asc_nulls_first(), F.col("dropped").desc(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("name").asc_nulls_first()]
    dealt = rows.repartitionByRange(-(-size // TASK_BYTES) or 1, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = written(dealt.mapInArrow(partial(_segments, most_rows=SEGMENT_ROWS), _SEGMENT), "segments")
    done = found.where("whole").select(
        "conv_id", F.coalesce(F.col("last") - F.col("first") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"),
    )
    open_ = found.where("NOT whole")
    pieces = written(open_.drop("texts", "roles").groupBy("conv_id").applyInArrow(_joined, _PIECE), "pieces")
    whole = pieces.where("audit IS NOT NULL").select(*_names(_WHOLE))
    texts = join_small(open_.select("conv_id", "number", "roles", "texts"), pieces.select("number", "piece", "state"), "number")
    hashes = texts.repartition("conv_id").sortWithinPartitions("conv_id", "number").mapInArrow(_hashed, _HASH)
    return done.unionByName(whole.join(hashes, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv"))


#: The same in DuckDB: crc32 bit by bit, then the backward pass and the forward walk as recursions over positions.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(k[i])::BIGINT FOR i IN range(1, len(k) + 1)],
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM keyed
), rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS times(i)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM rows_after
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, left(role, 1) AS i
  FROM placed
), faults AS (
  SELECT *, is_blank OR seen AS must, cut AND NOT is_blank AND NOT seen AS truncated, lead(i) OVER (PARTITION BY conv_id ORDER BY pos) AS following FROM judged
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (seen AND NOT is_blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (following IS NOT NULL AND i || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), back AS (
  SELECT conv_id, n + 1 AS pos, [0, 4, 2, 0] AS v, ' II ' AS edits FROM counts
  UNION ALL
  SELECT conv_id, pos, v, array_to_string([CASE WHEN v[s] = d[s] THEN 'D' WHEN v[s] = 2 + v[[3, 3, 4, 3][s]] THEN 'I' WHEN v[s] = k[s] THEN 'K' ELSE 'R' END FOR s IN [1, 2, 3, 4]], '')
  FROM (
    SELECT *, [least(one[s], 2 + one[[3, 3, 4, 3][s]]) FOR s IN [1, 2, 3, 4]] AS v FROM (
      SELECT *, [least(least(d[s], k[s], r[s]), 2 + least(d[[3, 3, 4, 3][s]], k[[3, 3, 4, 3][s]], r[[3, 3, 4, 3][s]])) FOR s IN [1, 2, 3, 4]] AS one FROM (
        SELECT f.conv_id, f.pos, [3 + b.v[s] FOR s IN [1, 2, 3, 4]] AS d,
          [CASE WHEN f.must THEN 1000000000 ELSE 2 + f.truncated::INT + b.v[[3, 3, 4, 3][s]] END FOR s IN [1, 2, 3, 4]] AS r,
          [CASE WHEN f.must THEN 1000000000 WHEN f.i = 's' AND s = 1 THEN f.truncated::INT + b.v[2]
                WHEN f.i = 'u' AND s <> 3 THEN f.truncated::INT + b.v[3] WHEN f.i = 'a' AND s = 3 THEN f.truncated::INT + b.v[4]
                ELSE 1000000000 END FOR s IN [1, 2, 3, 4]] AS k
        FROM back b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos - 1
      )))
), walk AS (
  SELECT conv_id, 1::BIGINT AS pos, 1 AS state, '' AS audit, '' AS said FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN pos ELSE pos + 1 END, state, audit || edit,
    CASE WHEN edit = 'D' THEN said ELSE said || CASE WHEN said = '' THEN '' ELSE chr(10) END
      || CASE edit WHEN 'K' THEN role || ':' || text WHEN 'R' THEN made || ':' || text ELSE made || ':' END END
  FROM (
    SELECT w.conv_id, w.pos, w.audit, w.said, b.edits[w.state] AS edit, f.role, f.text, CASE WHEN w.state = 3 THEN 'assistant' ELSE 'user' END AS made,
      CASE b.edits[w.state] WHEN 'D' THEN w.state WHEN 'K' THEN CASE f.i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE [3, 3, 4, 3][w.state] END AS state
    FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos = w.pos
    LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos
    WHERE b.edits[w.state] <> ' '
  )
), ended AS (
  SELECT w.conv_id, w.audit, w.said FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos = w.pos WHERE b.edits[w.state] = ' '
), costs AS (SELECT conv_id, v[1]::BIGINT AS cost FROM back WHERE pos = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN costs o ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
