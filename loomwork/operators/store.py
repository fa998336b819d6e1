"""Lists and counts over recorded events and findings, and short joins between them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import written

# Paths that development tools ask for, and kinds of calls that leave a project.
DEV_TOOLS = r"(\.hot-update\.(json|js)$|/_next/webpack-hmr|/__nextjs_|/__webpack_hmr|/@vite/|/@react-refresh|/__vite_ping|/_next/static/webpack/)"
OUTGOING = ("http", "ai", "email", "message", "payment", "database", "auth", "files")
STRENGTH = ("select", "update", "delete")


def is_dev_tool(path: Column) -> Column:
    """Whether a request is of development tools and not of the application."""
    return F.coalesce(path.rlike(DEV_TOOLS), F.lit(False))


def is_generated(path: Column, root: str = "") -> Column:
    """Whether some folder of a file, below root, begins with a dot."""
    inside = F.when(path.startswith(root), F.substring(path, len(root) + 1, 10_000)).otherwise(path)
    parts = F.split(inside, "/")
    return F.coalesce(F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".")), F.lit(False))


def action_list(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """action_id, run, at, segments, requests, pending: actions with their first time, pages crossed and server requests; pending if one has not ended.

    actions: action_id, run, segment, at; requests: action_id, ended (0 or 1).
    """
    seen = actions.groupBy("action_id").agg(F.min("run").alias("run"), F.min("at").alias("at"), F.count("*").alias("segments"))
    served = requests.groupBy("action_id").agg(F.count("*").alias("requests"), F.sum("ended").alias("ended"))
    both = seen.join(served, "action_id", "left")
    n = F.coalesce("requests", F.lit(0))
    return both.select("action_id", "run", "at", "segments", n.alias("requests"), (n > F.coalesce("ended", F.lit(0))).alias("pending"))


def run_list(requests: DataFrame, actions: DataFrame) -> DataFrame:
    """run, last, requests, actions: recordings with what they hold; a run may have either kind only."""
    r = requests.groupBy("run").agg(F.max("at").alias("a"), F.count("*").alias("requests"))
    s = actions.groupBy("run").agg(F.max("at").alias("b"), F.countDistinct("action_id").alias("actions"))
    both = r.join(s, "run", "full_outer")
    return both.select("run", F.greatest("a", "b").alias("last"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("actions", F.lit(0)).alias("actions"))


def reasons(limitations: DataFrame, by: str) -> DataFrame:
    """Per group: each reason and how often it limits it."""
    return limitations.groupBy(by, "reason").agg(F.count("*").alias("n"))


def with_details(functions: DataFrame, details: DataFrame, on: list[str]) -> DataFrame:
    """Functions with their recorded details, where there are any."""
    return functions.join(details, on, "left")


def recorded_files(files: DataFrame, events: DataFrame) -> DataFrame:
    """The files that a recording entered (events: run, type, file)."""
    return files.join(events.where("type = 'enter'").select("run", "file"), ["run", "file"], "left_semi")


def outgoing_calls(events: DataFrame, requests: DataFrame) -> DataFrame:
    """run, request_id, host, kind, provider, fields: calls to other hosts, with the names of the fields sent as the call's end says, else its start.

    events: request_id, process, id, type, kind, host, local, provider, fields; requests: request_id, run.
    """
    calls = events.where((F.col("type") == "boundary") & F.col("host").isNotNull() & ~F.coalesce("local", F.lit(False)) & F.col("kind").isin(*OUTGOING))
    ends = events.where("type = 'boundary-end'").select("process", "id", F.col("fields").alias("sent"))
    found = calls.join(ends, ["process", "id"], "left").join(requests.select("request_id", "run"), "request_id")
    return found.select("run", "request_id", "host", "kind", "provider", F.coalesce("sent", "fields").alias("fields"))


def marked_runs(rows: DataFrame, by: str, order: str, marked: Column, least: int = 2) -> DataFrame:
    """by, first, last, n: runs of so many adjacent marked rows or more."""
    w = Window.partitionBy(by).orderBy(order)
    flagged = rows.withColumn("marked", marked).withColumn("island", F.sum(F.when(F.col("marked"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = flagged.where("marked").groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("island")


def strongest(operations: DataFrame, by: list[str], operation: str) -> DataFrame:
    """Per group the strongest operation: delete over update over select over others."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STRENGTH]), F.lower(F.col(operation)))
    return operations.groupBy(*by).agg(F.max_by(F.lower(F.col(operation)), F.struct(rank, F.lower(F.col(operation)))).alias("operation"))


def by_longest_prefix(uses: DataFrame, services: DataFrame, module: str) -> DataFrame:
    """uses with service: that of the longest dotted prefix of the module, by name or for any name (*).

    uses: module, name; services: prefix, name, service.
    """
    parts = F.split(F.col(module), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    known = services.withColumnRenamed("name", "of_name")
    each = uses.select(module, "name").distinct().select(module, "name", F.explode(prefixes).alias("prefix"))
    met = each.join(known, "prefix").where("of_name = '*' OR of_name = name")
    best = met.groupBy(module, "name").agg(F.max_by("service", F.struct(F.length("prefix"), F.col("of_name") != "*", "service")).alias("service"))
    return uses.join(best, [module, "name"], "left").select(*uses.columns, "service")


def python_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """from, module, name, target: the file that a Python import means, or null for a package.

    Leading dots climb from the importing file's folder; absolute modules are tried from the
    project and from the file's own folder.  A name may be a submodule: it wins over the module.
    imports: from, module, name; files: path.
    """
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    tail = F.regexp_replace(F.regexp_replace("module", r"^\.+", ""), r"\.", "/")
    folders = F.split("folder", "/")
    climbed = F.array_join(F.slice(folders, 1, F.greatest(F.size(folders) - dots + 1, F.lit(0))), "/")
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")
    bases = F.when(dots > 0, F.array(joined(climbed, tail))).otherwise(F.array(tail, joined(F.array_join(folders, "/"), tail)))
    candidates = F.flatten(F.transform(bases, lambda b: F.array(
        joined(b, F.concat("name", F.lit(".py"))), joined(b, "name", F.lit("__init__.py")), F.concat(b, F.lit(".py")), joined(b, F.lit("__init__.py"))
    )))
    # of the importing file only its folder counts, so each distinct import of a folder is looked up once
    rows = imports.select("from", "module", "name").distinct().withColumn("folder", F.regexp_replace("from", r"/?[^/]*$", ""))
    key = F.struct("folder", "module", "name")  # as one value, so that imports without a name meet too
    asked = rows.select("folder", "module", "name").distinct().select(key.alias("key"), F.posexplode(candidates).alias("place", "path"))
    met = asked.join(files.select("path").distinct(), "path")
    found = met.groupBy("key").agg(F.min(F.struct("place", "path")).alias("b")).select("key", F.to_json("key").alias("said"), F.col("b.path").alias("target"))  # said: for the count of bytes
    return join_small(rows.withColumn("key", key), written(found, "modules"), "key", "left").select("from", "module", "name", "target")


def new_and_gone(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key and change: what only one of two versions has."""
    b, a = before.select(*key).distinct(), after.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("new")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("gone")))


def plain_json(text: Column) -> Column:
    """JSON without comments and final commas; what stands in texts stays."""
    # a text or a comment at a time: the text is kept, the comment isn't
    bare = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])', "$1")


def _stable(texts: pd.Series, without: pd.Series) -> pd.Series:
    """JSON with sorted keys, without one key at any depth, a whole number in one spelling; null for what isn't JSON."""
    def plain(value: object, key: str) -> object:
        if isinstance(value, dict):
            return {k: plain(v, key) for k, v in value.items() if k != key}
        if isinstance(value, list):
            return [plain(v, key) for v in value]
        return int(value) if isinstance(value, float) and value.is_integer() else value

    def stable(text: str | None, key: str) -> str | None:
        try:
            return None if text is None else json.dumps(plain(json.loads(text), key), sort_keys=True)
        except (ValueError, RecursionError):
            return None

    return pd.Series([stable(t, k) for t, k in zip(texts, without, strict=True)], dtype=object)


def same_json(one: Column, two: Column, without: str = "proof") -> Column:
    """Whether two JSON values say the same at every depth, with types, whatever the order of keys and apart from one key.

    Null where either is null, isn't JSON or is nested deeper than a thousand levels.
    """
    stable = F.pandas_udf(_stable, "string")
    return stable(one, F.lit(without)) == stable(two, F.lit(without))


def duplicate_sets(stretches: DataFrame) -> DataFrame:
    """files, stretches, tokens, places: stretches (id, file, tokens) by the set of files that share them."""
    one = stretches.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"), F.max("tokens").alias("tokens"), F.count("*").alias("places"))
    return one.groupBy("files").agg(F.count("*").alias("stretches"), F.sum("tokens").alias("tokens"), F.max("places").alias("places"))


def data_summary(tables: DataFrame) -> DataFrame:
    """One row: counts of tables, inferred ones, those with row rules, those whose rules are known.  tables: inferred, rls."""
    return tables.agg(
        F.count("*").alias("n_tables"), F.count_if("inferred").alias("inferred"), F.count_if("rls").alias("with_rls"), F.count_if(F.col("rls").isNotNull()).alias("rls_known")
    )


def badge(items: DataFrame, seen: DataFrame, opened: DataFrame, by: str) -> DataFrame:
    """by, changes, alerts, warnings, possibly, unread, opened: what the badge of each prompt counts.

    items: by, key, severity, origin, the sentences of a report; seen: by, key, those that
    were read; opened: by, the reports that were opened.
    """
    read = seen.select(by, "key").distinct().withColumn("read", F.lit(True))
    marked = items.join(read, [by, "key"], "left")
    severe = F.col("severity")
    counted = marked.groupBy(by).agg(
        F.count("*").alias("changes"), F.count_if(severe == "alert").alias("alerts"), F.count_if(severe == "warning").alias("warnings"),
        F.count_if(F.col("origin") == "possibly").alias("possibly"), F.count_if(F.col("read").isNull()).alias("unread"),
    )
    return counted.join(opened.select(by).distinct().withColumn("opened", F.lit(True)), by, "left").withColumn("opened", F.coalesce("opened", F.lit(False)))


def tallies(answers: DataFrame, by: str, order: str, recent: int = 50, project: str | None = None) -> DataFrame:
    """(project,) by, n, n_right, recent, recent_right: all answers of a kind and the right ones, and those among the newest so many of all kinds."""
    over = [project] if project else []
    if project:
        place = F.row_number().over(Window.partitionBy(project).orderBy(F.desc(order)))
        newest = answers.withColumn("place", place).where(F.col("place") <= recent).drop("place")
    else:
        newest = answers.orderBy(F.desc(order)).limit(recent)
    late = newest.groupBy(*over, by).agg(F.count("*").alias("recent"), F.count_if("is_right").alias("recent_right"))
    every = answers.groupBy(*over, by).agg(F.count("*").alias("n"), F.count_if("is_right").alias("n_right"))
    return every.join(late, [*over, by], "left").fillna(0, ["recent", "recent_right"])


def unknown_share(files: DataFrame, by: str, block: str = "block") -> DataFrame:
    """by, share: the share of files that no rule places."""
    return files.groupBy(by).agg(F.avg(F.when(F.col(block) == "unknown", 1.0).otherwise(0.0)).alias("share"))


# Kinds of findings that are red or only worth knowing; all others are yellow.
RED_FINDINGS = ("public-secret", "env-tracked", "literal-key", "no-rls-browser")
INFO_FINDINGS = ("remote-supabase",)
YELLOW_KEYS = ("stripe-test", "google")


def finding_level(kind: Column, key: Column | None = None, is_read: Column | None = None) -> Column:
    """red, yellow or info by a finding's kind.

    A key written in code that is a test key or often public by design is yellow, and
    so is a secret under a public name that no code reads yet.
    """
    milder = F.lit(False)
    if key is not None:
        milder = milder | ((kind == "literal-key") & F.coalesce(key.isin(*YELLOW_KEYS), F.lit(False)))
    if is_read is not None:
        milder = milder | ((kind == "public-secret") & ~F.coalesce(is_read, F.lit(False)))
    return F.when(kind.isin(*INFO_FINDINGS), "info").when(kind.isin(*RED_FINDINGS) & ~milder, "red").otherwise("yellow")
