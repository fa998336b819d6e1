"""Operators of overviews: search, leaks, cards, facts, comparisons, settings, and the replay of schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as fn


def search(nodes: DataFrame, words: str, kinds: list[str], most: int = 50) -> DataFrame:
    """Nodes (id, kind, name, path) whose name or path has the words, exact names first, then by id."""
    needle = words.lower()
    found = nodes.where(F.col("kind").isin(*kinds) & F.lower(F.concat_ws("\n", "name", "path")).contains(needle))
    return found.orderBy(F.lower("name") != needle, "id").limit(most)


def clipped(events: DataFrame, text: list[str], lists: dict[str, int], most: int = 120) -> DataFrame:
    """Events with texts cut to so many characters and lists to so many items."""
    cut = {c: F.substring(c, 1, most) for c in text} | {c: F.slice(c, 1, n) for c, n in lists.items()}
    return events.withColumns(cut)


def compact_input(tool: Column, path: Column, command: Column) -> Column:
    """What a tool was given, in one short text: its path or its command."""
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
    return F.when(tool.isin("Bash", "Shell"), short(command, 600)).otherwise(short(F.coalesce(path, command), 200))


def exit_code(response: Column) -> Column:
    """The exit code that a tool's answer begins with."""
    return F.nullif(F.regexp_extract(response, r"^\s*Exit code (\d+)", 1), F.lit("")).try_cast("int")


def leaks(calls: DataFrame, services: DataFrame) -> DataFrame:
    """service, category, hosts, fields, sources, n, in_browser: what leaves a project, by service; unknown hosts are services of their own.

    calls: host, service (or null), fields (array), file, runs_on; services: service, category.  Browser calls come first, then by category and name.
    """
    named = calls.withColumn("service", F.coalesce("service", F.concat(F.lit("host:"), "host")))
    grouped = named.groupBy("service").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("host")).alias("hosts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"),
        F.array_sort(F.collect_set("file")).alias("sources"), F.bool_or(F.col("runs_on").isin("client", "both")).alias("in_browser"),
    )
    joined = grouped.join(services.select("service", "category"), "service", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    return joined.orderBy(F.desc("in_browser"), "category", F.lower("service"), "service")


def observed_only(observed: DataFrame, calls: DataFrame) -> DataFrame:
    """Hosts that a recording saw and the code doesn't show."""
    return observed.groupBy("host").agg(F.count("*").alias("n")).join(calls.select("host"), "host", "left_anti")


def plan_arrows(edges: DataFrame, proofs: int = 5) -> DataFrame:
    """src, dst, n, kinds (map of counts), runs_on, change, proofs: arrows between boxes.

    edges: src, dst, kind, runs_on, added, removed, proof.
    """
    kinds = edges.groupBy("src", "dst", "kind").agg(
        F.count("*").alias("k"), F.collect_set("runs_on").alias("r"), F.bool_or("added").alias("added"), F.bool_or("removed").alias("removed"),
        F.slice(F.array_sort(F.collect_set("proof")), 1, proofs).alias("p"),
    )
    change = F.when(F.col("added") & F.col("removed"), "changed").when(F.col("added"), "added").when(F.col("removed"), "removed")
    return kinds.groupBy("src", "dst").agg(
        F.sum("k").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "k")))).alias("kinds"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))), "+").alias("runs_on"),
        F.bool_or("added").alias("added"), F.bool_or("removed").alias("removed"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), 1, proofs).alias("proofs"),
    ).withColumn("change", change).drop("added", "removed")


def block_cards(files: DataFrame, exports: DataFrame, edges: DataFrame, largest: int = 3) -> DataFrame:
    """block, n_files, lines, largest, folders, rules, n_exports, uses, used_by: what a card says of each block.

    files: path, block, rule, lines; exports: path, name; edges: src_block, dst_block, n.
    """
    rank = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("lines"), "path"))
    top = files.withColumn("k", rank).where(F.col("k") <= largest).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("t"))
    base = files.groupBy("block").agg(
        F.count("*").alias("n_files"), F.sum("lines").alias("lines"), F.countDistinct(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("folders"), F.array_sort(F.collect_set("rule")).alias("rules")
    )
    exported = exports.join(files.select("path", "block"), "path").groupBy("block").agg(F.count("*").alias("n_exports"))
    uses = edges.groupBy(F.col("src_block").alias("block")).agg(F.sum("n").alias("uses"))
    used = edges.groupBy(F.col("dst_block").alias("block")).agg(F.sum("n").alias("used_by"))
    card = base.join(top, "block").join(exported, "block", "left").join(uses, "block", "left").join(used, "block", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_exports", "uses", "used_by")}
    return card.withColumns({"largest": F.transform("t", lambda x: x["path"]), **zero}).drop("t")


def compared(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, status (same, missing, extra, different), fields: an expected graph against the one that was read."""
    e, a = expected.select(key, F.struct(*fields).alias("e")), actual.select(key, F.struct(*fields).alias("a"))
    both = e.join(a, key, "full_outer")
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.size(unlike) > 0, "different").otherwise("same")
    return both.select(key, status.alias("status"), F.when(status == "different", unlike).otherwise(F.array().cast("array<string>")).alias("fields"))


def union_graph(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The nodes of now and those that are gone, marked."""
    gone = before.join(after.select(key), key, "left_anti")
    return after.withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)), allowMissingColumns=True)


def recording_summary(events: DataFrame) -> DataFrame:
    """run, processes, requests, functions, boundaries, limitations; a process that only starts others (a supervisor) doesn't count."""
    supervisors = events.where("type = 'process' AND role = 'supervisor'").select("run", "process").distinct()
    own = events.join(supervisors, ["run", "process"], "left_anti")
    return own.groupBy("run").agg(
        F.countDistinct("process").alias("processes"), F.countDistinct(F.when(F.col("type") == "request", F.col("requestId"))).alias("requests"),
        F.countDistinct(F.when(F.col("type") == "enter", F.struct("file", "function", "line"))).alias("functions"),
        F.count_if(F.col("type") == "boundary").alias("boundaries"), F.count_if(F.col("type") == "limitation").alias("limitations"),
    )


def projects(prompts: DataFrame) -> DataFrame:
    """project, n, last: projects with their prompts, the newest first."""
    return prompts.groupBy("project").agg(F.count("*").alias("n"), F.max("started").alias("last")).orderBy(F.desc("last"), "project")


def resolved_point(snapshots: DataFrame, ref: str) -> DataFrame:
    """The snapshot that a reference means: latest, or an id or label."""
    if ref == "latest":
        return snapshots.orderBy(F.desc("created"), F.desc("id")).limit(1)
    return snapshots.where((F.col("id") == ref) | (F.col("label") == ref)).orderBy(F.desc("created"), F.desc("id")).limit(1)


def settings(chosen: DataFrame, defaults: DataFrame) -> DataFrame:
    """kind, value, own: each setting as chosen, else by default; unknown kinds are left out."""
    return defaults.join(chosen.select("kind", F.col("value").alias("c")), "kind", "left").select("kind", F.coalesce("c", "value").alias("value"), F.col("c").isNotNull().alias("own"))


def unsupported_words(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """sentence_id, words: names in a sentence (paths, calls, CONSTANTS, snake_case) that no fact has."""
    names = F.regexp_extract_all("text", F.lit(r"\b(?:[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+|[A-Za-z_][A-Za-z0-9_]*\(\)|[a-z0-9]+(?:_[a-z0-9]+)+|[A-Z][A-Z0-9]*_[A-Z0-9_]+)"), 0)
    each = sentences.select("sentence_id", F.explode(F.array_distinct(names)).alias("name")).withColumn("name", F.regexp_replace("name", r"\(\)$", ""))
    return each.join(known.select("name"), "name", "left_anti").groupBy("sentence_id").agg(F.array_sort(F.collect_list("name")).alias("words"))


def interpretation(answer: DataFrame, files: DataFrame) -> DataFrame:
    """path, change: an answer's files (path, wanted): existing ones are changed, new valid ones added; removed ones must exist."""
    clean = answer.withColumn("path", F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+|/+$", ""))
    known = clean.join(files.select("path", F.lit(True).alias("exists")), "path", "left")
    valid = ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/") & (F.length("path").between(1, 300))
    change = F.when((F.col("wanted") == "remove") & F.col("exists"), "removed").when((F.col("wanted") != "remove") & F.col("exists"), "changed").when((F.col("wanted") != "remove") & valid, "added")
    return known.select("path", change.alias("change")).where("change IS NOT NULL").distinct()


def replayed_schema(statements: DataFrame) -> DataFrame:
    """project, table, columns: the tables that a project's schema statements leave.

    statements: project, seq, action (create, drop, rename, add, drop-column), table, name, to.
    A table's last creation counts and what comes after it; a rename carries a table's columns
    on (one rename a table); a column is there if its last change added it.
    """
    renames = statements.where("action = 'rename'").select("project", "table", F.col("to").alias("new"), F.col("seq").alias("renamed"))
    moved = statements.where("action <> 'rename'").join(renames, ["project", "table"], "left")
    rows = moved.withColumn("table", F.when(F.col("seq") < F.col("renamed"), F.col("new")).otherwise(F.col("table"))).drop("new", "renamed")
    life = rows.where("action IN ('create', 'drop')").groupBy("project", "table").agg(F.max_by("action", "seq").alias("last"), F.max(F.when(F.col("action") == "create", F.col("seq"))).alias("created"))
    alive = life.where("last = 'create'").select("project", "table", "created")
    changes = rows.where("action IN ('add', 'drop-column')").join(alive, ["project", "table"]).where("seq >= created")
    columns = changes.groupBy("project", "table", "name").agg(F.max_by("action", "seq").alias("last"), F.min("seq").alias("first")).where("last = 'add'")
    listed = columns.groupBy("project", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda c: c["name"]).alias("columns"))
    none = F.array().cast("array<string>")
    return alive.join(listed, ["project", "table"], "left").select("project", "table", F.coalesce("columns", none).alias("columns"))


def unguarded_routes(routes: DataFrame) -> DataFrame:
    """route_id, level: new routes whose code shows no session check: warning for those that write, else info.

    routes: route_id, method, text.
    """
    checks = r"(?i)\b(getServerSession|getSession|auth\(\)|currentUser|requireAuth|requireUser|ensureLoggedIn|isAuthenticated|verifyToken|jwt\.verify|login_required|Depends\(\s*get_current_user)"
    open_ = routes.where(~F.coalesce(F.col("text").rlike(checks), F.lit(False)))
    return open_.select("route_id", F.when(F.upper("method").isin("POST", "PUT", "PATCH", "DELETE"), "warning").otherwise("info").alias("level"))


def fact_rows(files: DataFrame, most: int = 5) -> DataFrame:
    """section, fact: for each block its count of files and the first ones by path."""
    first = files.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("path"))).where(F.col("place") <= most)
    shown = first.groupBy("block").agg(F.array_sort(F.collect_list("path")).alias("p"))
    counted = files.groupBy(F.col("block").alias("of")).agg(F.count("*").alias("n"))
    grouped = shown.join(counted, F.col("block").eqNullSafe(F.col("of"))).drop("of")
    more = F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return grouped.select(F.col("block").alias("section"), F.concat(F.col("n").cast("string"), F.lit(" files: "), F.array_join("p", ", "), more).alias("fact"))


def alert_keys(items: DataFrame, columns: list[str]) -> DataFrame:
    """items with key: a short hash of the columns that make an alert the same one."""
    return items.withColumn("key", fn.short_hash(F.concat_ws("\n", *columns), 16))
