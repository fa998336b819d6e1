"""What files use, as graphs with proofs (tables, variables, services), and lists and checks on such graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as fn
from loomwork.sized import join_small

# Proofs kept of an edge, operations that read, addresses of the own machine, and services whose key must stay on a server.
PROOFS = 12
READS = ["select"]
LOCAL = r"^(localhost|127\.\d+\.\d+\.\d+|\[?::1\]?|0\.0\.0\.0)$"
SECRET_ONLY = ["ai", "email", "messaging"]
BROWSER = ["client", "both"]


def with_proofs(uses: DataFrame, keys: list[str], most: int = PROOFS) -> DataFrame:
    """The distinct keys with proof: their first places, as file:line, by file and line.

    Only the first places of a key are gathered, however often it is used.
    """
    places = uses.select(*keys, "file", "line").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("file", "line"))
    first = F.array_sort(F.collect_list(F.struct("file", "line")))
    shown = F.transform(first, lambda p: F.concat_ws(":", p["file"], p["line"].cast("string")))
    return places.withColumn("place", place).where(F.col("place") <= most).groupBy(*keys).agg(shown.alias("proof"))


def _user() -> Column:
    return F.when(F.col("symbol").isNotNull(), F.concat(F.lit("symbol:"), "file", F.lit("#"), "symbol")).otherwise(F.concat(F.lit("file:"), "file"))


def table_edges(uses: DataFrame) -> DataFrame:
    """kind (reads, writes), src, dst, operations, proof: which function, else which file, uses which table.

    uses: file, line, symbol (null outside functions), table, operation; rows without a table are left out.
    """
    kind = F.when(F.col("operation").isin(READS), "reads").otherwise("writes")
    edges = uses.where("table IS NOT NULL").select(kind.alias("kind"), _user().alias("src"), F.concat(F.lit("table:"), "table").alias("dst"), "operation", "file", "line")
    keys = ["kind", "src", "dst"]
    operations = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("operation")).alias("operations"))
    return with_proofs(edges, keys).join(operations, keys)


def used_tables(uses: DataFrame, defined: DataFrame) -> DataFrame:
    """table, inferred: tables that a schema defines, and those that are only seen in use."""
    named = uses.where("table IS NOT NULL").select("table", F.lit(True).alias("inferred")).union(defined.select("table", F.lit(False)))
    return named.groupBy("table").agg(F.min("inferred").alias("inferred"))


def variables(defined: DataFrame, reads: DataFrame, prefixes: list[str]) -> DataFrame:
    """name, public, secret_like, defined, read: environment variables with the places that set and read them.

    defined, reads: file, line, name.  A variable is public if its name begins with one of the prefixes.
    """
    public = F.lit(False)
    for prefix in prefixes:
        public = public | F.col("name").startswith(prefix)
    places = defined.select("name", "file", "line", F.lit(1).alias("d")).union(reads.select("name", "file", "line", F.lit(0))).distinct()
    found = places.groupBy("name").agg(F.sum("d").alias("defined"), F.sum(1 - F.col("d")).alias("read"))
    return found.select("name", public.alias("public"), fn.is_secret_like(F.col("name")).alias("secret_like"), "defined", "read")


def variable_edges(reads: DataFrame) -> DataFrame:
    """kind (uses-secret, reads), src, dst, proof: which file reads which variable."""
    kind = F.when(fn.is_secret_like(F.col("name")), "uses-secret").otherwise("reads")
    edges = reads.select(kind.alias("kind"), F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("env:"), "name").alias("dst"), "file", "line")
    return with_proofs(edges, ["kind", "src", "dst"])


def service_calls(calls: DataFrame, hosts: DataFrame, kits: DataFrame) -> DataFrame:
    """Calls with service and category: by a written host (known or not), by a variable that holds the address, by a kit.

    calls: host, env, package, name, and more; hosts: host, service, category; kits: package,
    name, service, category.  Calls of the own machine and of unknown kits are left out.
    """
    by_host = hosts.select("host", F.col("service").alias("hs"), F.col("category").alias("hc"))
    by_kit = kits.select("package", "name", F.col("service").alias("ks"), F.col("category").alias("kc"))
    met = join_small(join_small(calls, by_host, "host", "left"), by_kit, ["package", "name"], "left")
    written = F.col("host").isNotNull()
    service = F.when(written, F.coalesce("hs", "host")).when(F.col("env").isNotNull(), F.concat(F.lit("env:"), "env")).otherwise(F.col("ks"))
    category = F.when(written, F.coalesce("hc", F.lit("http"))).when(F.col("env").isNotNull(), "http").otherwise(F.col("kc"))
    named = met.withColumn("service", service).withColumn("category", category)
    return named.where(F.col("service").isNotNull() & ~F.coalesce(F.col("host").rlike(LOCAL), F.lit(False))).drop("hs", "hc", "ks", "kc")


def service_edges(calls: DataFrame) -> DataFrame:
    """src, dst, category, proof: which function, else which file, sends data to which service (calls of service_calls, with file, line, symbol)."""
    edges = calls.select(_user().alias("src"), F.concat(F.lit("service:"), "service").alias("dst"), "category", "file", "line")
    return with_proofs(edges, ["src", "dst", "category"])


def called_from_browser(calls: DataFrame) -> DataFrame:
    """service, files, proof: services with a secret key that code in the browser calls (calls of service_calls, with file, line, runs_on)."""
    found = calls.where(F.col("category").isin(SECRET_ONLY) & F.col("runs_on").isin(BROWSER))
    return found.groupBy("service").agg(F.countDistinct("file").alias("files")).join(with_proofs(found, ["service"]), "service")


def passed_checks(looked_at: DataFrame, findings: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """check, n: checks that had something to look at and found nothing.

    looked_at: check, n; findings: kind; kinds: the kinds of finding that fail each check.
    """
    pairs = [F.struct(F.lit(check).alias("check"), F.lit(kind).alias("kind")) for check, each in kinds.items() for kind in each]
    failed = findings.select("kind").distinct().select(F.explode(F.filter(F.array(*pairs), lambda p: p["kind"] == F.col("kind"))).alias("p")).select("p.check").distinct()
    return looked_at.groupBy("check").agg(F.sum("n").alias("n")).where("n > 0").join(failed, "check", "left_anti")


def visible_boxes(nodes: DataFrame, opened: DataFrame) -> DataFrame:
    """id, box: the box that stands for a node while only some boxes are open.

    nodes: id, kind (block, file or other), file, block; opened: id.  A closed block stands for
    all in it, a closed file for its symbols; a node without a file has no box.
    """
    of = lambda name: opened.select(F.col("id").alias(name), F.lit(True).alias(f"{name}_open")).distinct()
    met = nodes.join(of("block"), "block", "left").join(of("file"), "file", "left")
    box = (
        F.when(F.col("kind") == "block", F.col("id")).when(F.col("file").isNull(), None).when(F.col("block_open").isNull(), F.col("block"))
        .when((F.col("kind") == "file") | F.col("file_open").isNull(), F.col("file")).otherwise(F.col("id"))
    )
    return met.select("id", box.alias("box"))


def workspace_members(patterns: DataFrame, folders: DataFrame) -> DataFrame:
    """project, folder: members of a workspace, by patterns that name a folder or, with a final /* or /**, the folders right in it.

    patterns: project, pattern; folders: project, folder (those with a manifest).  Patterns that exclude, or with a star elsewhere, name nothing.
    """
    clean = F.regexp_replace(F.regexp_replace("pattern", r"/\*\*?$", ""), "/$", "")
    named = patterns.where(~F.col("pattern").startswith("!")).select("project", clean.alias("at"), F.col("pattern").rlike(r"/\*\*?$").alias("inside"))
    named = named.where("inside OR NOT contains(at, '*')").distinct()
    above = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise("")
    each = F.array(F.struct(F.col("folder").alias("at"), F.lit(False).alias("inside")), F.struct(above.alias("at"), F.lit(True).alias("inside")))
    placed = folders.select("project", "folder", F.explode(each).alias("p")).select("project", "folder", "p.at", "p.inside")
    return placed.join(named, ["project", "at", "inside"], "left_semi").select("project", "folder").distinct()


def change_counts(changes: DataFrame, by: list[str]) -> DataFrame:
    """alert, warning, info, touching: changes of each group by severity, and those that touch something (changes: severity, touches)."""
    of = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return changes.groupBy(*by).agg(of("alert"), of("warning"), of("info"), F.count_if(F.size("touches") > 0).alias("touching"))


def cross_origin(origin: Column, host: Column) -> Column:
    """The origin (scheme://host) of a request from another host than its own, else null."""
    scheme = F.lower(F.regexp_extract(origin, r"^(?i)(https?)://", 1))
    found = F.lower(F.regexp_extract(origin, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#]+)", 1))
    port = F.when(scheme == "https", ":443$").otherwise(":80$")
    found = F.regexp_replace(found, port, F.lit(""))
    return F.when((scheme != "") & (found != "") & (found != host), F.concat(scheme, F.lit("://"), found))


def tag_position(html: Column, final: bool = True) -> Column:
    """Where a tag can be put into a page: after the head's start, else before the body, else after the root's or the document type's start.

    Counted from 0; -1 if there is no such place, null if the page has no head yet and goes on.
    """
    blank = r"(?:\s|<!--[\s\S]*?-->)*+"
    start = lambda p: F.regexp_instr(html, F.lit(p)) - 1
    size = lambda p: F.length(F.regexp_extract(html, p, 0))
    head, body = r"(?i)<head(?:\s[^>]*)?>", r"(?i)<body[\s>]"
    root, kind = rf"(?i)^{blank}(?:<!doctype html[^>]*>{blank})?<html(?:\s[^>]*)?>", rf"(?i)^{blank}<!doctype html[^>]*>"
    after = F.when(size(root) > 0, size(root)).when(size(kind) > 0, size(kind)).otherwise(-1)
    rest = F.when(start(body) >= 0, start(body)).otherwise(after) if final else F.lit(None).cast("int")
    return F.when(html.isNull(), None).when(start(head) >= 0, start(head) + size(head)).otherwise(rest)
