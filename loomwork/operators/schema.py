"""Tables and columns that schema statements leave, by following names instead of running statements in turn.

A statement that names something means what that name stood for just before it.  Each
creation, renaming and removal is an event of a name; what a renamed thing is follows
from the event before its renaming, and so on back to its creation, found by pointers
that double.  So the statements of a project need not come together in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import checkpointed, written

# Names of tables and columns, and words that end a column's type.
_NAME = r"(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*)(?:\.(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*))?"
_TYPE_ENDS = re.compile(r"(?i)\b(?:not\s+null|null|primary\s+key|references|default|unique|check|generated|constraint|collate)\b")
_CREATE = re.compile(rf"(?i)create\s+(?:(?:global|local)\s+)?(?:(?:temp|temporary|unlogged)\s+)?table\s+(?:if\s+not\s+exists\s+)?({_NAME})")
_DROP = re.compile(r"(?is)drop\s+table\s+(?:if\s+exists\s+)?(.+?)(?:\s+(?:cascade|restrict))?\Z")
_ALTER = re.compile(rf"(?i)alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?({_NAME})\s+")
_PIECE = re.compile(r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|\$(\w*)\$[\s\S]*?(?:\$\1\$|\Z)|;|[^;'\"$/-]+|.", re.DOTALL)


def _plain(name: str) -> str:
    """A name without quotes and public schema; unquoted parts in lower case."""
    parts = re.findall(r"\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[^.\s]+", name.strip())
    parts = [p[1:-1] if p[0] in '"`[' else p.lower() for p in parts]
    return ".".join(parts[1:] if len(parts) > 1 and parts[0] == "public" else parts)


def statements(text: str) -> list[tuple[int, str]]:
    """(line, statement) of a text of SQL: cut at semicolons outside of comments, texts, names and dollar quotes; comments go."""
    out, now, line, begun = [], [], 1, 1
    for m in _PIECE.finditer(text):
        piece = m[0]
        if piece == ";":
            out.append((begun, "".join(now).strip()))
            now = []
        elif not piece.startswith(("--", "/*")):
            if not "".join(now).strip():
                now, begun = [], line + len(piece[: len(piece) - len(piece.lstrip())].split("\n")) - 1
            now.append(piece)
        line += piece.count("\n")
    return [(k, s) for k, s in [*out, (begun, "".join(now).strip())] if s]


def _parts(text: str) -> list[str]:
    """What stands between commas outside of brackets and quotes."""
    out, depth, begin, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth <= 0:
            out.append(text[begin:k].strip())
            begin = k + 1
    return [p for p in [*out, text[begin:].strip()] if p]


def _inner(text: str, at: int) -> str | None:
    """The text between the bracket at that place and its partner."""
    depth, quote = 0, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at + 1 : k]
    return None


_FIELDS = ("action", "name", "to", "type", "primary_key", "nullable", "is_unique", "references")


def _reference(text: str) -> str | None:
    m = re.search(rf"(?i)\breferences\s+({_NAME})\s*(?:\(([^)]*)\))?", text)
    return None if not m else _plain(m[1]) + (f".{_plain(m[2].split(',')[0])}" if m[2] and m[2].strip() else "")


def _column(text: str) -> dict | None:
    m = re.match(rf"(?s)({_NAME})\s*(.*)", text)
    if not m:
        return None
    end = _TYPE_ENDS.search(m[2])
    kind, rest = (m[2], "") if not end else (m[2][: end.start()], m[2][end.start() :])
    key = bool(re.search(r"(?i)\bprimary\s+key\b", rest))
    return {
        "action": "add", "name": _plain(m[1]), "type": " ".join(kind.lower().split()) or None, "primary_key": key, "nullable": not key and not re.search(r"(?i)\bnot\s+null\b", rest),
        "is_unique": bool(re.search(r"(?i)\bunique\b", rest)), "references": _reference(rest),
    }


def _constraint(text: str) -> list[dict] | None:
    """What a constraint of a table says of its columns; None if the text is no constraint."""
    body = re.sub(r"(?i)^constraint\s+\S+\s+", "", text)
    m = re.match(r"(?i)(primary\s+key|foreign\s+key|unique)\s*\(([^)]*)\)", body)
    if not m:
        return [] if re.match(r"(?i)(?:check|exclude)\b", body) else None
    names = [_plain(n) for n in m[2].split(",") if n.strip()]
    kind = m[1].lower().split()[0]
    if kind == "primary":
        return [{"action": "set", "name": n, "primary_key": True, "nullable": False} for n in names]
    if kind == "foreign":
        to = _reference(body)
        return [{"action": "set", "name": n, "references": to} for n in names if to]
    return [{"action": "set", "name": names[0], "is_unique": True}] if len(names) == 1 else []


def _defined(text: str) -> list[dict]:
    found = _constraint(text)
    if found is None:
        column = None if re.match(r"(?i)like\b", text) else _column(text)
        found = [column] if column else []
    return found


def _altered(action: str) -> tuple[str, str] | list[dict]:
    """What one action of ALTER TABLE does: the new name of the table, or rows about columns."""
    if m := re.fullmatch(rf"(?i)rename\s+to\s+({_NAME})", action):
        return ("rename", _plain(m[1]))
    if m := re.fullmatch(rf"(?i)rename\s+(?:column\s+)?({_NAME})\s+to\s+({_NAME})", action):
        return [{"action": "rename", "name": _plain(m[1]), "to": _plain(m[2])}]
    if (m := re.match(rf"(?i)drop\s+(?:column\s+)?(?:if\s+exists\s+)?({_NAME})", action)) and not re.match(r"(?i)drop\s+constraint\b", action):
        return [{"action": "drop", "name": _plain(m[1])}]
    if m := re.match(r"(?i)add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?", action):
        return _defined(action[m.end() :])
    return []


def ddl(text: str | None) -> list[tuple]:
    """(line, what, table, to, and of a column: action, name, to, type, primary_key, nullable, is_unique, references) of the schema statements of a text, in order.

    what is create, drop, rename (of a table) or column.
    """
    out: list[tuple] = []

    def say(line: int, what: str, table: str, to: str | None = None, column: dict | None = None) -> None:
        out.append((line, what, table, to, *[(column or {}).get(f) for f in _FIELDS]))

    for line, text_ in statements(text or ""):
        if m := _CREATE.match(text_):
            table, after = _plain(m[1]), text_[m.end() :]
            say(line, "create", table)
            open_ = text_.find("(", m.end())
            inner = _inner(text_, open_) if open_ >= 0 and not re.match(r"(?i)\s*(?:as|partition)\b", after) else None
            for part in _parts(inner or ""):
                for column in _defined(part):
                    say(line, "column", table, None, column)
        elif m := _DROP.match(text_):
            for name in m[1].split(","):
                if name.strip():
                    say(line, "drop", _plain(name))
        elif m := _ALTER.match(text_):
            table = _plain(m[1])
            for part in _parts(text_[m.end() :]):
                done = _altered(part)
                if isinstance(done, tuple):
                    say(line, "rename", table, done[1])
                    table = done[1]
                else:
                    for column in done:
                        say(line, "column", table, None, column)
    return out


_ROW = [("project", pa.string()), ("path", pa.string()), ("k", pa.int64()), ("line", pa.int64()), ("what", pa.string()), ("table", pa.string()), ("table_to", pa.string())]
_ROW += [(f, pa.bool_() if f in ("primary_key", "nullable", "is_unique") else pa.string()) for f in _FIELDS]
_ROW_DDL = ", ".join(f"`{n}` {'long' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'string'}" for n, t in _ROW)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_ROW)
    for batch in batches:
        rows = []
        for project, path, text in zip(*(batch.column(c).to_pylist() for c in ("project", "path", "text")), strict=True):
            rows += [(project, path, k, *r) for k, r in enumerate(ddl(text))]
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def schema_statements(sources: DataFrame) -> DataFrame:
    """The schema statements of SQL files (project, path, text), a row for each thing they say; k is its place in the file."""
    rows = sources.select(F.col("project").cast("string").alias("project"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_read, _ROW_DDL)


def _origins(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """place and origin: the end of each node's pointers (place, to, is_end), null where they lead nowhere."""
    while not nodes.where("NOT is_end AND to IS NOT NULL").isEmpty():
        step = nodes.select(*scope, F.col("place").alias("to"), F.col("to").alias("next"), F.col("is_end").alias("stops"))
        met = nodes.join(step, [*scope, "to"], "left")
        nodes = checkpointed(met.select(
            *scope, "place", F.when(F.col("is_end"), F.col("to")).otherwise(F.col("next")).alias("to"), (F.col("is_end") | F.coalesce("stops", F.lit(False))).alias("is_end")
        ))
    return nodes.select(*scope, "place", F.when(F.col("is_end"), F.col("to")).alias("origin"))


def followed_names(events: DataFrame, scope: list[str], at: list[str]) -> tuple[DataFrame, DataFrame]:
    """events with identity, and (scope, identity, name) of what has a name in the end.

    events: scope, at (an event's place in its scope, no two alike), kind (open, close,
    rename or use), name, to.  An identity is the place, a struct of at, of the opening
    event that the event's name stands for just before it (for an opening: its own), null
    if the name stands for nothing.  Renamings of nothing are as if they weren't there: the
    earliest such ones of each scope are taken out first, as they change what later ones mean.
    """
    place = F.struct(*at)
    rows = written(events.withColumn("place", place), "events")
    rename = F.col("kind") == "rename"
    first = rows.select(*scope, "place", F.lit(0).alias("half"), F.when(rename, "close").otherwise(F.col("kind")).alias("kind"), "name", rename.alias("renames"))
    second = rows.where(rename).select(*scope, "place", F.lit(1).alias("half"), F.lit("from").alias("kind"), F.col("to").alias("name"), rename.alias("renames"))
    live, done = first.unionByName(second), []
    while True:
        before = Window.partitionBy(*scope, "name").orderBy("place", "half").rowsBetween(Window.unboundedPreceding, -1)
        named = F.last(F.when(F.col("kind") != "use", F.struct("place", "kind")), ignorenulls=True).over(before)
        last = F.max(F.when(F.col("kind") != "use", F.struct("place", "half"))).over(Window.partitionBy(*scope, "name"))
        seen = live.withColumns({"named": named, "last": last})
        seen = written(seen.select(*scope, "place", "half", "kind", "name", "renames", F.when(F.col("named.kind") != "close", F.col("named.place")).alias("target"), (F.col("last") == F.struct("place", "half")).alias("is_last")), "named")
        renamed = seen.where("half = 0 AND renames").select(*scope, "place", F.col("target").alias("to"))
        opened = seen.where("kind = 'open'").select(*scope, "place", F.col("place").alias("to"), F.lit(True).alias("is_end"))
        origins = written(_origins(checkpointed(opened.unionByName(renamed.withColumn("is_end", F.lit(False)))), scope), "origins")
        lost = renamed.select(*scope, "place").join(origins.where("origin IS NOT NULL"), [*scope, "place"], "left_anti")
        void = checkpointed(lost.groupBy(*scope).agg(F.min("place").alias("place")))
        if void.isEmpty():
            done.append((seen, origins))
            break
        again = void.select(*scope)
        done.append((seen.join(again, scope, "left_anti"), origins.join(again, scope, "left_anti")))
        live = seen.select(*scope, "place", "half", "kind", "name", "renames").join(again, scope, "left_semi").join(void, [*scope, "place"], "left_anti")
    seen, origins = (written(reduce(DataFrame.unionByName, part), name) for part, name in zip(zip(*done, strict=True), ("named", "origins"), strict=True)) if len(done) > 1 else done[0]
    known = origins.select(*scope, F.col("place").alias("target"), F.col("origin").alias("identity"))
    starts = seen.where("kind IN ('open', 'from')").select(*scope, "place", "half", "name", "is_last", F.col("place").alias("target"))
    final = starts.where("is_last").join(known, [*scope, "target"]).where("identity IS NOT NULL").select(*scope, "identity", "name")
    target = F.when(F.col("kind") == "open", F.col("place")).otherwise(F.col("target"))
    found = seen.where("half = 0").select(*scope, "place", target.alias("target")).join(known, [*scope, "target"], "left").select(*scope, "place", "identity")
    return rows.join(found, [*scope, "place"], "left").drop("place"), final


def replayed(rows: DataFrame) -> DataFrame:
    """project, table, columns, path, line: the tables that a project's schema statements leave, and where each was created.

    rows: as schema_statements gives them; files count in the order of their paths.  A
    column is a struct of name, type, primary_key, nullable, is_unique and references, in
    the order in which columns were added.  A table that is created again starts anew, an
    added column of a known name replaces that one, and renamed things keep what they had.
    """
    kind = F.when(F.col("what") == "create", "open").when(F.col("what") == "drop", "close").when(F.col("what") == "rename", "rename").otherwise("use")
    said = rows.where("what IS NOT NULL").withColumnsRenamed({"name": "column", "to": "column_to"})
    tables, left = followed_names(said.withColumns({"kind": kind, "name": F.col("table"), "to": F.col("table_to")}), ["project"], ["path", "k"])
    created = tables.where("what = 'create'").select("project", "identity", "path", "line")
    left = written(left.withColumnRenamed("name", "table").join(created, ["project", "identity"]), "tables")
    about = tables.where("what = 'column' AND identity IS NOT NULL").join(left.select("project", "identity"), ["project", "identity"], "left_semi")
    kind = F.when(F.col("action") == "add", "open").when(F.col("action") == "drop", "close").when(F.col("action") == "rename", "rename").otherwise("use")
    about = about.withColumnRenamed("identity", "of").withColumns({"kind": kind, "name": F.col("column"), "to": F.col("column_to")})
    columns, stay = followed_names(about, ["project", "of"], ["path", "k"])
    place = F.struct("path", "k")
    facts = columns.where("identity IS NOT NULL AND action IN ('add', 'set')").groupBy("project", "of", "identity").agg(
        F.max_by("type", F.when(F.col("action") == "add", place)).alias("type"), F.coalesce(F.bool_or("primary_key"), F.lit(False)).alias("primary_key"),
        F.coalesce(F.bool_and("nullable"), F.lit(True)).alias("nullable"), F.coalesce(F.bool_or("is_unique"), F.lit(False)).alias("is_unique"),
        F.max_by("references", F.when(F.col("references").isNotNull(), place)).alias("references"),
    )
    each = stay.join(facts, ["project", "of", "identity"]).select("project", F.col("of").alias("identity"), F.struct(F.col("identity").alias("at"), "name", "type", "primary_key", "nullable", "is_unique", "references").alias("c"))
    listed = each.groupBy("project", "identity").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.dropFields("at")).alias("columns"))
    none = F.array().cast(listed.schema["columns"].dataType)
    return left.join(listed, ["project", "identity"], "left").select("project", "table", F.coalesce("columns", none).alias("columns"), "path", "line")
