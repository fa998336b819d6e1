"""Operators on the structure of a project: files, imports, symbols, layers, exposure and copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as fn
from loomwork.sized import join_small
from loomwork.storage import checkpointed, written

# Endings that an import may leave out, in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", ".css")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def _plain(path: Column, rounds: int = 6) -> Column:
    """A path without . and .. parts (so many nested ones)."""
    path = F.regexp_replace(path, r"(^|/)\./", "$1")
    path = F.regexp_replace(path, r"/{2,}", "/")
    for _ in range(rounds):
        path = F.regexp_replace(path, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return path


# What may follow an import's path, in the order in which it is tried; last, sources of a compiled file's name.
_ENDINGS = ("", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS])
_SOURCES = (".ts", ".tsx", ".mts", ".cts")
_COMPILED = (".js", ".mjs", ".cjs")


def _known_roots(files: DataFrame) -> DataFrame:
    """root, place: the paths without endings that files are found by, and the first ending that finds one."""
    path = F.col("path")
    less = lambda ending, instead="": F.concat(F.substring(path, F.lit(1), F.length(path) - len(ending)), F.lit(instead))
    ways = [(k, e, "") for k, e in enumerate(_ENDINGS)] + [(len(_ENDINGS) + k, e, c) for k, e in enumerate(_SOURCES) for c in _COMPILED]
    each = F.array_compact(F.array(*[F.when(path.endswith(e), F.struct(less(e, c).alias("root"), F.lit(k).alias("place"))) for k, e, c in ways]))
    return files.select(F.explode(each).alias("r")).groupBy("r.root").agg(F.min("r.place").alias("place"))


def _rooted(imports: DataFrame, aliases: list[tuple[str, str]] | None) -> DataFrame:
    """imports with roots: the paths without endings that each may mean, in order; none for a package."""
    spec = F.regexp_replace("specifier", r"[?#].*$", "")
    base = F.when(spec.startswith("."), _plain(F.concat(_folder(F.col("from")), spec))).when(spec.startswith("/"), F.substring(spec, 2, 10_000))
    roots = [F.array_compact(F.array(base))]
    for pattern, target in aliases or []:
        head, star, tail = pattern.partition("*")
        fits = spec.startswith(head) & spec.endswith(tail) if star else spec == pattern
        middle = F.substring(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail))
        to_head, to_star, to_tail = target.partition("*")
        made = F.concat(F.lit(to_head), middle, F.lit(to_tail)) if to_star else F.lit(target)
        inside = spec.startswith(".") & F.col("from").isNotNull() | spec.startswith("/")
        roots.append(F.when(fits & ~inside, F.array(made)).otherwise(F.array().cast("array<string>")))
    return imports.withColumn("roots", F.concat(*roots))


def _met_roots(rooted: DataFrame, files: DataFrame, keep: list[str]) -> DataFrame:
    """roots, keep, target: the file that each distinct list of roots means, if one does."""
    lists = rooted.where(F.size("roots") > 0).select("roots", *keep).distinct()
    met = lists.select("roots", *keep, F.posexplode("roots").alias("nth", "root")).join(_known_roots(files), "root")
    n = len(_ENDINGS) + len(_SOURCES)
    first = met.groupBy("roots", *keep).agg(F.min(F.col("nth") * n + F.col("place")).alias("first"))
    place, root = F.col("first") % n, F.get("roots", F.floor(F.col("first") / n).cast("int"))
    source = F.concat(F.regexp_replace(root, r"\.[mc]?js$", ""), F.get(F.array(*[F.lit(e) for e in _SOURCES]), place - len(_ENDINGS)))
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), place)
    return first.select("roots", *keep, F.when(place < len(_ENDINGS), F.concat(root, ending)).otherwise(source).alias("target"))


def with_targets(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """imports (from, specifier and more) with target (a project file) and package: what each means.

    files: path.  A relative specifier is joined to its folder, one with / starts at the
    project; an alias (pattern with *, target) is tried next, and what is left names a
    package.  Files are listed under the few paths without endings that lead to them, and
    each distinct such path of an import is looked up once, so no import has a row for each ending.
    """
    rooted = _rooted(imports, aliases)
    # what has no roots meets nothing and is dealt out by its own hash
    deal = F.when(F.size("roots") > 0, F.lit(0).cast("long")).otherwise(F.xxhash64("from", "specifier"))
    found = written(_met_roots(rooted, files, []).withColumn("deal", F.lit(0).cast("long")), "roots")
    met = join_small(rooted.withColumn("deal", deal), found, ["roots", "deal"], "left")
    package = F.when(F.col("target").isNull() & ~F.col("specifier").rlike(r"^[./]"), fn.package_name(F.col("specifier")))
    return met.select(*imports.columns, "target", package.alias("package"))


def resolved_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """from, specifier, target, package: what each distinct import means, as in with_targets."""
    return with_targets(imports.select("from", "specifier").distinct(), files, aliases)


def imported(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The distinct target (a project file) and keep of the imports, without the imports: as in with_targets."""
    keep = keep or []
    return _met_roots(_rooted(imports, aliases), files, keep).select("target", *keep).distinct()


def import_edges(imports: DataFrame) -> DataFrame:
    """src, dst, n, names, proofs: one edge for each pair of files, its distinct proofs (line) and the sorted names it takes."""
    rows = imports.where("target IS NOT NULL")
    return rows.groupBy(F.col("from").alias("src"), F.col("target").alias("dst")).agg(
        F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.array_sort(F.collect_set("line")).alias("lines")
    )


# Layers of files by path; the first rule that fits wins.
LAYERS = [
    ("config", "dotenv", r"(^|/)\.env[^/]*$"),
    ("config", "project-meta", r"(^|/)(package(-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|pyproject\.toml|requirements[^/]*\.txt|(ts|js)config(\..+)?\.json|[^/]*\.(config|preset)\.[mc]?[jt]s|\.(eslintrc|prettierrc|babelrc|swcrc)[^/]*)$|^[^/]+\.mdx?$"),
    ("tests", "test-file", r"\.(test|spec)\.[mc]?[jt]sx?$|(^|/)(__tests__|test|tests|e2e|cypress|playwright)/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"),
    ("data", "database-schema", r"\.(sql|prisma)$|(^|/)migrations/"),
    ("utilities", "generated", r"\.(gen|generated)\.[mc]?[jt]sx?$|(^|/)__generated__/"),
    ("routes", "next-app-router:route", r"(^|/)app/(.+/)?route\.[tj]s$"),
    ("routes", "next-pages-router:api", r"(^|/)pages/api/"),
    ("interface", "html-entry", r"\.html?$"),
    ("config", "config-module", r"(^|/)config(\.[mc]?[jt]s$|/)"),
    ("routes", "folder:routes", r"(^|/)(routes|api|controllers|handlers|endpoints|routers|middlewares?)/"),
    ("logic", "folder:services", r"(^|/)(services|usecases|use-cases|domain|actions)/"),
    ("interface", "ui-file", r"\.(jsx|tsx|vue|svelte|css)$"),
    ("interface", "folder:interface", r"(^|/)(components|pages|views|layouts|screens|ui|hooks)/"),
    ("utilities", "utilities", r"(^|/)(utils?|helpers?|shared|common)/|(^|[/.-])(utils?|helpers?)([.-][^/]*)?\.[^./]+$"),
    ("config", "folder:scripts", r"^(scripts|bin|tools)/"),
    ("logic", "folder:lib", r"(^|/)(lib|core|logic|modules|features|stores?|state)/"),
    ("utilities", "types", r"\.d\.ts$|(^|/)@?types/"),
    ("config", "documentation", r"\.mdx?$"),
]


def layer(path: Column, own: list[tuple[str, str]] | None = None) -> Column:
    """struct(block, rule) of a file: a user's own globs first, then the rules in order, else unknown."""
    out = F.struct(F.lit("unknown").alias("block"), F.lit("no-rule").alias("rule"))
    rules = [(block, f"own:{glob}", fn.glob_pattern(glob)) for block, glob in own or []] + LAYERS
    for block, rule, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), F.struct(F.lit(block).alias("block"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


# Files that a runner starts without an import, and places where a convention may.
TEST_FILE = r"(?:^|/)(?:__tests__|__mocks__|tests?|e2e|cypress|playwright)/|\.(?:test|spec|stories|story)\.[cm]?[jt]sx?$|(?:^|/)(?:test_[^/]*|[^/]*_test|conftest)\.py$"
CONFIG_FILE = r"(?:^|/)[\w.-]+\.(?:config|preset)\.[cm]?[jt]s$|(?:^|/)\.?[\w-]+rc\.[cm]?js$"
PYTHON_ENTRY = r"(?:^|/)(?:__init__|__main__|manage|wsgi|asgi)\.py$|(?:^|/)(?:migrations|alembic)/.*\.py$"
CONVENTION_FOLDER = r"(?:^|/)(?:pages|routes|api|functions|workers?|scripts|bin|cli|commands|plugins|migrations|seeds?|jobs|cron)/"
PUBLIC_FOLDER = r"^(?:.*/)?(?:public|static)/"
ENTRY_NAME = r"(?:^|/)(?:index|main|server|app|worker|cli|handler|lambda)\.(?:[cm]?[jt]sx?|py)$"


def dead_files(files: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """path, certainty of files that nothing imports: possible where a convention may start them, else sure."""
    lone = files.select("path").join(edges.select(F.col("dst").alias("path")), "path", "left_anti")
    if entries is not None:
        lone = lone.join(entries.select("path"), "path", "left_anti")
    any_of = lambda *patterns: F.col("path").rlike("|".join(patterns))
    lone = lone.where(~any_of(TEST_FILE, CONFIG_FILE, PYTHON_ENTRY))
    return lone.select("path", F.when(any_of(CONVENTION_FOLDER, PUBLIC_FOLDER, ENTRY_NAME), "possible").otherwise("sure").alias("certainty"))


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """path, name of exports that no importer takes, in files that are imported by name only."""
    taken = imports.where("target IS NOT NULL").select(F.col("target").alias("path"), F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("*")))).alias("name")).distinct()
    taken = written(taken, "taken")
    some = taken.groupBy("path").agg(F.bool_or(F.col("name") == "*").alias("whole")).where("NOT whole").select("path")
    return exports.select("path", "name").join(some, "path", "left_semi").join(taken, ["path", "name"], "left_anti")


def stable_symbols(symbols: DataFrame) -> DataFrame:
    """symbols (path, name, line) with stable_id: the name, with ~2, ~3 … for later ones of a name in a file."""
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("line"))
    return symbols.withColumn("stable_id", F.concat("path", F.lit("#"), "name", F.when(n > 1, F.concat(F.lit("~"), n.cast("string"))).otherwise("")))


#: Lines of a file that are walked together: a symbol is dealt to each such stretch that it reaches into.
_LINES = 4096


def _walk_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a file in order, symbols before points and of one line the first name last, give each point its symbol.

    The open symbols are a stack: one that ends no later than another that starts later
    (or on the same line, with a smaller name) can never be the answer again and goes.
    Names of the line that is being walked stand beside it.
    """
    at_key, at_line, stack, here, least = None, None, [], set(), None
    for batch in batches:
        kept, ranks, starts, symbols = [], [], [], []
        for k, (path, bin_, line, is_point, to, variable, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "bin", "line", "is_point", "to", "variable", "name")), strict=True)):
            if (path, bin_) != at_key:
                at_key, at_line, stack = (path, bin_), None, []
            if line != at_line or at_line is None:
                at_line, here, least = line, set(), None
            if not is_point:
                while stack and stack[-1][0] <= to:
                    stack.pop()
                stack.append((to, line, name))
                here.add(name)
                least = name if variable is False else least  # names come in falling order
                continue
            while stack and line is not None and stack[-1][0] < line:
                stack.pop()
            found = (0, line, name) if name is not None and name in here else (1, line, least) if least is not None else (2, *stack[-1][1:]) if stack and line is not None else (3, None, None)
            kept.append(k)
            for values, value in zip((ranks, starts, symbols), found, strict=True):
                values.append(value)
        points = batch.take(pa.array(kept, pa.int64()))
        columns = [points.column("point_id"), points.column("path"), pa.array(ranks, pa.int32()), pa.array(starts, pa.int64()), pa.array(symbols, pa.string())]
        yield pa.record_batch(columns, names=["point_id", "path", "rank", "start", "symbol"])


def located(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """point_id, symbol, via: the symbol of each position (path, name, line): by key, by line, innermost around it, else the file.

    A file's positions and symbols are walked together in the order of lines, a stretch of
    lines at a time, with only the symbols in memory that are still open: no position meets
    the other symbols of its file, and a long file is dealt out.
    """
    line = F.col("line").cast("long")
    to = F.greatest(F.coalesce("end_line", "line").cast("long"), line)  # a symbol is at least on its own line
    kind = points.schema["point_id"].dataType
    known = symbols.where("path IS NOT NULL AND line IS NOT NULL AND name IS NOT NULL").select(
        F.lit(None).cast(kind).alias("point_id"), "path", F.explode(F.sequence(F.floor(line / _LINES), F.floor(to / _LINES))).alias("bin"), line.alias("line"), F.lit(False).alias("is_point"),
        F.coalesce("end_line", "line").cast("long").alias("to"), (F.col("kind") == "variable").alias("variable"), "name",
    )
    none = F.lit(None)
    asked = points.select("point_id", "path", F.floor(line / _LINES).alias("bin"), line.alias("line"), F.lit(True).alias("is_point"), none.cast("long").alias("to"), none.cast("boolean").alias("variable"), "name")
    dealt = known.unionByName(asked).repartition("path", "bin").sortWithinPartitions("path", "bin", "line", "is_point", F.desc("name"))
    schema = f"point_id {kind.simpleString()}, path string, rank int, start long, symbol string"
    each = dealt.mapInArrow(_walk_symbols, schema)
    best = each.groupBy("point_id", "path").agg(F.min(F.struct("rank", (-F.col("start")).alias("f"), "symbol")).alias("b"))  # of a position that comes twice
    via = F.get(F.array(F.lit("key"), F.lit("line"), F.lit("enclosing")), F.col("b.rank"))
    return best.select("point_id", F.coalesce("b.symbol", "path").alias("symbol"), F.coalesce(via, F.lit("file")).alias("via"))


def composed_routes(mounts: DataFrame, routes: DataFrame) -> DataFrame:
    """route_id, path: routes with the prefixes of all mounts of their router, followed to the app.

    mounts: holder, child, prefix; routes: route_id, router, path.  A router that is mounted
    nowhere has no prefix; several mounts give several paths; a way that comes back to a router is left.
    Rounds go on until every way has ended.
    """
    done = None
    open_ = checkpointed(routes.select("route_id", F.col("router").alias("at"), "path", F.array("router").alias("seen")))
    step = mounts.select(F.col("child").alias("at"), "holder", "prefix")
    while done is None or not open_.isEmpty():
        met = open_.join(step, "at", "left")
        top = met.where(F.col("holder").isNull()).select("route_id", "path")
        done = top if done is None else done.union(top)
        open_ = checkpointed(met.where(F.col("holder").isNotNull() & ~F.array_contains("seen", F.col("holder"))).select(
            "route_id", F.col("holder").alias("at"), F.concat("prefix", F.lit("/"), "path").alias("path"), F.concat("seen", F.array("holder")).alias("seen")
        ))
    return done.select("route_id", fn.route_path(F.regexp_replace("path", "^/+", "")).alias("path")).distinct()


def tree_depth(steps: DataFrame, most: int = 64) -> DataFrame:
    """steps (trace, id, parent) with depth: 0 for those without a known parent, else one more than the parent's.

    Pointers double each round, so a tree of depth d takes log2(d) rounds.
    """
    known = steps.select("trace", F.col("id").alias("parent"), F.col("id").alias("up"))
    at = steps.select("trace", "id", "parent").join(known, ["trace", "parent"], "left").select("trace", "id", "up")
    at = at.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    at = checkpointed(at)
    for _ in range(most):
        if at.where("up IS NOT NULL").isEmpty():
            break
        above = at.select("trace", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        at = checkpointed(at.join(above, ["trace", "up"], "left").select("trace", "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return at.select("trace", "id", "depth")


def subtree_sums(steps: DataFrame, values: list[str]) -> DataFrame:
    """steps (trace, id, parent) with the sums of the values over all steps below each, itself left out.

    Two things double each round: the step that a pointer leads up to, and the stretch of
    levels whose sums a step holds.  A tree of depth d takes log2(d) rounds of one
    aggregate by (trace, ancestor) with partial sums, however broad or deep it is; no
    step's descendants are gathered.  Steps that are their own ancestors end the rounds
    with an error.  A parent that isn't there is none.
    """
    known = steps.select("trace", F.col("id").alias("parent"), F.col("id").alias("up"))
    at = steps.select("trace", "id", "parent", *[F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values])
    at = written(at.join(known, ["trace", "parent"], "left").select("trace", "id", "up", *values, *[F.col(v).alias(f"own_{v}") for v in values]), "steps")
    before = None
    while True:
        moving = at.where("up IS NOT NULL").count()
        if moving == 0:
            break
        if moving == before:
            raise ValueError("steps that are above themselves")
        before = moving
        below = at.where("up IS NOT NULL").groupBy("trace", F.col("up").alias("id")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        above = at.select("trace", F.col("id").alias("up"), F.col("up").alias("next"))
        grown = at.join(below, ["trace", "id"], "left").join(above, ["trace", "up"], "left")
        sums = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        at = checkpointed(grown.select("trace", "id", F.col("next").alias("up"), *sums, *[f"own_{v}" for v in values]))
    return at.select("trace", "id", *[(F.col(v) - F.col(f"own_{v}")).alias(v) for v in values])


def collected(steps: DataFrame) -> DataFrame:
    """trace, id, functions, boundaries, errors: what stands below each step.  steps: trace, id, parent, type, error."""
    counted = steps.select(
        "trace", "id", "parent", (F.coalesce("type", F.lit("")) != "boundary").cast("long").alias("functions"), (F.coalesce("type", F.lit("")) == "boundary").cast("long").alias("boundaries"),
        F.coalesce(F.col("error").cast("boolean"), F.lit(False)).cast("long").alias("errors"),
    )
    return subtree_sums(counted, ["functions", "boundaries", "errors"])


# secrets and data


def env_exposure(variables: DataFrame, reads: DataFrame, prefixes: list[str]) -> DataFrame:
    """name, kind: secrets that a browser can see, by a public prefix or by browser code that reads them (inferred).

    variables: name; reads: name, runs_on.
    """
    public = F.lit(False)
    for p in prefixes:
        public = public | F.col("name").startswith(p)
    secret = variables.select("name").distinct().where(fn.is_secret_like(F.col("name")))
    browser = reads.where(F.col("runs_on").isin("client", "both")).select("name").distinct().withColumn("in_browser", F.lit(True))
    kind = F.when(public, "public-secret").when(F.col("in_browser"), "secret-in-browser")
    return secret.join(browser, "name", "left").select("name", kind.alias("kind")).where("kind IS NOT NULL")


def data_findings(tables: DataFrame, uses: DataFrame) -> DataFrame:
    """table, kind, level: tables open to browsers, used but not defined, defined but never used.

    tables: table, rls (true, false or null: not known); uses: table, runs_on.
    """
    used = uses.groupBy("table").agg(F.bool_or(F.col("runs_on").isin("client", "both")).alias("browser"))
    both = tables.select("table", "rls", F.lit(True).alias("defined")).join(used, "table", "full_outer")
    kind = (
        F.when(F.col("defined").isNull(), "used-not-defined").when(F.col("browser").isNull(), "defined-never-used")
        .when(F.col("browser") & ~F.col("rls"), "no-rls-browser").when(F.col("browser") & F.col("rls").isNull(), "rls-unknown")
    )
    level = F.when(kind == "no-rls-browser", "red").when(kind.isin("used-not-defined", "rls-unknown"), "yellow").otherwise("info")
    return both.select("table", kind.alias("kind"), level.alias("level")).where("kind IS NOT NULL")


# Development files, and names and values of variables that point to real things.
DEVELOPMENT = r"(?:^|/)\.env(\.local|\.development|\.development\.local)?$"
LIVE_KEY = r"^(?:sk|rk|pk)_live_"
DATABASE = r"(?:^|_)(?:DATABASE|DB|POSTGRES(?:QL)?|PG|MYSQL|MONGO(?:DB)?|REDIS)(?:_[A-Z]+)*_(?:URL|URI|HOST|DSN)$|^(?:DB|PG|MYSQL|POSTGRES)_?HOST$"
SUPABASE = r"SUPABASE.*_URL$"
PRODUCTION_FLAG = r"^(?:NODE_ENV|FLASK_ENV|APP_ENV|ENVIRONMENT|ENV|PYTHON_ENV|RAILS_ENV)$"
LOCAL_HOST = r"(?i)^(?:localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|::1|\[::1\]|host\.docker\.internal|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|[^.:]+)$"


def settings(files: DataFrame) -> DataFrame:
    """path, line, variable, value of the assignments in environment files (path, text).

    A value may be quoted; after a plain one a comment may follow.
    """
    def assignment(line: Column, at: Column) -> Column:
        raw = F.regexp_replace(line, r"^\s*(export\s+)?|\r$", "")
        left, right = F.rtrim(F.substring_index(raw, "=", 1)), F.trim(F.substring(raw, F.instr(raw, "=") + 1, F.length(raw)))
        mark = F.substring(right, 1, 1)
        last = F.length(right) - F.instr(F.reverse(right), mark) + 1  # place of the last such mark
        plain = F.regexp_replace(right, r"\s+#.*$", "")
        value = F.when(mark.isin('"', "'") & (last > 1), F.substring(right, F.lit(2), last - 2)).otherwise(plain)
        assigned = raw.contains("=") & left.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        return F.when(assigned, F.struct((at + 1).alias("line"), left.alias("variable"), value.alias("value")))

    # the rows are made before they are asked about, so that no rule repeats how a value was read
    each = files.select("path", F.explode(F.transform(F.split("text", "\n"), assignment)).alias("s")).where("s IS NOT NULL")
    return each.select("path", "s.line", "s.variable", "s.value")


def environment_facts(files: DataFrame) -> DataFrame:
    """path, line, variable, kind: development settings that point to real things; values are read and dropped.

    files: path, text.  Each rule is a pattern of names, one of values, and whether the
    value must name a host elsewhere; the first rule that fits counts.
    """
    rules = [("live-key", "", LIVE_KEY, False), ("remote-supabase", SUPABASE, "", True), ("remote-database", DATABASE, "", True), ("production-mode", PRODUCTION_FLAG, "(?i)^prod(?:uction)?$", False)]
    known = settings(files.where(F.col("path").rlike(DEVELOPMENT)))
    in_address = fn.host_of(F.col("value"))
    bare = F.when(F.col("value").rlike(r"^[A-Za-z0-9.-]+(:\d+)?$"), F.substring_index("value", ":", 1))
    no_host = F.col("value").rlike(r"\$\{?[A-Za-z_]|(?i)^(?:sqlite|file):")
    host = F.when(no_host, "").when(F.col("value").contains("://"), in_address).otherwise(F.coalesce(bare, F.lit("")))
    elsewhere = (F.length(host) > 0) & ~host.rlike(LOCAL_HOST)
    fits = [F.when(F.col("variable").rlike(name) & F.col("value").rlike(value) & (elsewhere | F.lit(not remote)), kind) for kind, name, value, remote in rules]
    return known.select("path", "line", "variable", F.coalesce(*fits).alias("kind")).where("kind IS NOT NULL")


# copies of code

# Comments, texts, numbers, names and signs of code (possessive, so that long texts take no stack).
_TOKEN_JS = r"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\.)*+`|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|\b\d[\d_.]*(?:e[+-]?\d+)?n?\b|[A-Za-z_$][\w$]*|=>|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\.\.\.|[{}()\[\];,.<>+\-*/%=!?:&|^~@#]"
_TOKEN_PY = r"#[^\n]*|'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|\b\d[\d_.]*(?:e[+-]?\d+)?j?\b|[A-Za-z_]\w*|->|==|!=|<=|>=|\*\*|//|:=|[{}()\[\];,.<>+\-*/%=!?:&|^~@]"


def code_tokens(text: Column, python: bool = False) -> Column:
    """Tokens of code: comments gone, texts and numbers alike."""
    found = F.regexp_extract_all(text, F.lit(_TOKEN_PY if python else _TOKEN_JS), 0)
    comment = r"^#" if python else r"^(//|/\*)"
    kept = F.filter(found, lambda t: ~t.rlike(comment))
    return F.transform(kept, lambda t: F.when(t.rlike("^[\"'`]"), '"s"').when(t.rlike("^[0-9]"), "0").otherwise(t))


#: Odd bases of the two rolling hashes, and what undoes them.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _rolling(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash for each run of n tokens, from sums of hashes times powers of the base: no window is read again."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), base, np.uint64)], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes) - n, pow(base, -1, 2**64), np.uint64)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:-1], dtype=np.uint64)]
    return (sums[n:] - sums[:-n]) * back


def _windows(n: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for doc, tokens in zip(batch.column("doc").to_pylist(), batch.column("tokens"), strict=True):
                words = tokens.as_py() or []
                if len(words) >= n:
                    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
                    one, two = (_rolling(hashes, n, base).view(np.int64) for base in _BASES)
                    at = np.arange(len(one), dtype=np.int32)
                    yield pa.record_batch([pa.array(one), pa.array(two), pa.array(np.full(len(one), doc, np.int64)), pa.array(at)], names=["h1", "h2", "doc", "at"])

    return cut


def _repeated_windows(sources: DataFrame, n: int) -> DataFrame:
    """h1, h2, doc, at of the windows whose first hash stands in two places or more.

    That hash alone is dealt out to find them; where few are, the others are never shuffled with their places.
    """
    windows = sources.select(F.col("doc").cast("long").alias("doc"), "tokens").mapInArrow(_windows(n), "h1 long, h2 long, doc long, at int")
    often = written(windows.groupBy("h1").agg(F.count("*").alias("k")).where("k > 1").select("h1"), "often")
    return join_small(windows, often, "h1", "left_semi")


def copied_stretches(sources: DataFrame, n: int) -> DataFrame:
    """one, one_at, two, two_at, length: maximal stretches of n tokens or more that a source shares with the first place that has them.

    sources: doc, tokens.  Each window of n tokens meets the first place of its hash, so that a
    window in many places gives one row for each, not one for each pair; neighbouring windows
    with the same shift join to one stretch.
    """
    windows = written(_repeated_windows(sources, n), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("k")).where("k > 1").select("h1", "h2", "f")
    met = windows.join(first, ["h1", "h2"]).where(~((F.col("doc") == F.col("f.doc")) & (F.abs(F.col("at") - F.col("f.at")) < n)))
    met = met.select(F.col("f.doc").alias("one"), F.col("f.at").alias("one_at"), F.col("doc").alias("two"), F.col("at").alias("two_at"))
    shift = F.col("two_at") - F.col("one_at")
    w = Window.partitionBy("two", "one", shift).orderBy("two_at")
    island = F.col("two_at") - F.row_number().over(w)
    runs = met.withColumn("shift", shift).withColumn("island", island).groupBy("one", "two", "shift", "island").agg(
        F.min("one_at").alias("one_at"), F.min("two_at").alias("two_at"), (F.count("*") + n - 1).alias("length")
    )
    return runs.select("one", "one_at", "two", "two_at", "length")


def lined_words(text: Column, pattern: str = "[A-Za-z0-9]+") -> Column:
    """(tokens, lines) of a text: its words in order, and the line (from 1) of each."""
    each = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract_all(x, F.lit(pattern), 0))
    numbers = F.transform(each, lambda words, i: F.transform(words, lambda _: i + 1))
    return F.struct(F.flatten(each).alias("tokens"), F.flatten(numbers).alias("lines"))


def least_period(words: list[str]) -> int:
    """The least shift under which a list agrees with itself (its length, if there is none)."""
    fall = [0] * len(words)
    for k in range(1, len(words)):
        j = fall[k - 1]
        while j and words[k] != words[j]:
            j = fall[j - 1]
        fall[k] = j + (words[k] == words[j])
    return len(words) - (fall[-1] if fall else 0)


def copies(sources: DataFrame, n: int = 80, least_lines: int = 8) -> DataFrame:
    """one, one_at, two, two_at, length: copied stretches whose tokens were compared, of so many lines in both places, that don't repeat themselves.

    sources: doc (unique), tokens, lines.  A stretch that consists of one part twice or more (a
    list of alike lines) is no copy.  Sources are written once; each stretch is read again in both places.
    """
    kept = written(sources.select("doc", "tokens", "lines").where(F.size("tokens") >= n), "sources")
    cut = lambda end, c: F.slice(c, F.col(f"{end}_at") + 1, F.col("length").cast("int"))
    found = copied_stretches(kept, n)
    for end in ("two", "one"):
        text = kept.select(F.col("doc").alias(end), "tokens", "lines")
        place = cut(end, "lines")
        found = found.join(text, end).withColumn(f"{end}_lines", F.element_at(place, -1) - F.element_at(place, 1) + 1).withColumn(f"{end}_words", cut(end, "tokens"))
        found = found.where(F.col(f"{end}_lines") >= least_lines).drop("tokens", "lines")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[least_period(list(w)) > len(w) / 2 for w in batch.pop("words")]]

    same = found.where("one_words = two_words").select("one", "one_at", "two", "two_at", "length", F.col("one_words").alias("words"))
    return same.mapInPandas(own, "one long, one_at int, two long, two_at int, length long")


def duplicated(sources: DataFrame, n: int = 80, least_lines: int = 8) -> DataFrame:
    """stretch, doc, at, length, line, end_line: every place of each stretch of n tokens or more that stands in two places or more.

    sources: doc (unique), tokens, lines.  Windows of n tokens belong to one stretch as
    long as all of their places go on together, so each stretch is as long as all its
    places allow, and where one place ends a shorter set may go on as another stretch.
    What tells a window's set of places is a sum over them, so no set is gathered.
    Places of one source that overlap count once; a stretch that repeats itself, or has
    fewer lines than least_lines in any place, is none.  A stretch is named by its first place.
    """
    kept = written(sources.select(F.col("doc").cast("long").alias("doc"), "tokens", "lines").where(F.size("tokens") >= n), "sources")
    windows = written(_repeated_windows(kept, n), "windows")
    often = windows.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    before = Window.partitionBy("h1", "h2", "doc").orderBy("at")
    rows = windows.join(often, ["h1", "h2"]).withColumn("lag", F.lag("at").over(before)).where(F.col("lag").isNull() | (F.col("at") - F.col("lag") >= n)).drop("lag")
    rows = written(rows, "rows")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("k")).where("k > 1")
    placed = written(rows.join(first, ["h1", "h2"]).select("h1", "h2", "doc", "at", "k", F.col("f.doc").alias("one"), F.col("f.at").alias("one_at")), "placed")
    shift = F.col("at") - F.col("one_at")
    signs = placed.groupBy("h1", "h2").agg(F.sum(F.xxhash64("doc", shift).cast("decimal(38,0)")).alias("places"))
    marked = placed.join(signs, ["h1", "h2"]).withColumn("shift", shift)
    run = Window.partitionBy("doc", "one", "shift", "k", "places").orderBy("at")
    island = F.col("at") - F.row_number().over(run)
    runs = marked.withColumn("island", island).groupBy("doc", "one", "shift", "k", "places", "island").agg(F.min("at").alias("at"), F.min("one_at").alias("one_at"), (F.count("*") + n - 1).cast("int").alias("length"))
    cut = lambda c: F.slice(c, F.col("at") + 1, F.col("length"))
    read = runs.join(kept, "doc").select("doc", "at", "length", "k", "one", "one_at", F.element_at(cut("lines"), 1).alias("line"), F.element_at(cut("lines"), -1).alias("end_line"), cut("tokens").alias("words"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = [least_period(list(w)) > len(w) / 2 for w in batch.pop("words")]
            yield batch.assign(own=whole)

    names = "doc long, at int, length int, k long, one long, one_at int, line int, end_line int, own boolean"
    each = written(read.mapInPandas(own, names), "places")
    good = each.groupBy("one", "one_at", "length").agg(F.count("*").alias("n"), F.min(F.col("end_line") - F.col("line") + 1).alias("least"), F.bool_and("own").alias("own"), F.max("k").alias("k"))
    good = good.where((F.col("n") == F.col("k")) & (F.col("least") >= least_lines) & F.col("own")).select("one", "one_at", "length")
    return each.join(good, ["one", "one_at", "length"]).select(F.concat_ws(":", "one", "one_at", "length").alias("stretch"), "doc", "at", "length", "line", "end_line")
