"""Operators on recorded behaviour: dossiers, boundaries, effects, plans to run again, and live steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as fn

# Operations by what they do to a database.
READS = ("SELECT", "SHOW", "EXPLAIN", "GET", "FIND", "COUNT", "AGGREGATE")
WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "UPSERT")
STRUCTURE = ("CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME")
# Hosts of providers, by kind.
PROVIDERS = {
    "api.openai.com": ("ai", "OpenAI"), "api.anthropic.com": ("ai", "Anthropic"), "generativelanguage.googleapis.com": ("ai", "Google"), "api.mistral.ai": ("ai", "Mistral"),
    "api.stripe.com": ("payment", "Stripe"), "api.resend.com": ("email", "Resend"), "api.sendgrid.com": ("email", "SendGrid"), "api.mailgun.net": ("email", "Mailgun"),
    "api.twilio.com": ("message", "Twilio"),
}
# Paths of model servers, and what methods do to a table behind a REST address.
API_PATHS = r"^/(v1/(chat/completions|completions|responses|messages)|api/(chat|generate))$"
REST_OPERATIONS = {"GET": "SELECT", "HEAD": "SELECT", "POST": "INSERT", "PATCH": "UPDATE", "PUT": "UPSERT", "DELETE": "DELETE"}
RERUN = ("GET", "HEAD")
MAX_REQUESTS = 20


def http_boundary(method: Column, url: Column, authorization: Column | None = None, content_sha256: Column | None = None) -> Column:
    """struct(kind, provider, operation, host, path, local, tables, mode, bucket) of an outgoing request; the first rule that fits wins.

    authorization and content_sha256 are headers of the request, where they are known.
    """
    host, path, keys = fn.host_of(url), fn.path_of(url), fn.query_keys(url)
    none = F.lit(None).cast("string")
    authorization = F.lit("") if authorization is None else F.coalesce(authorization, F.lit(""))
    local = fn.is_local(host)
    compatible = path.rlike(API_PATHS)
    signed = authorization.startswith("AWS4-HMAC-SHA256") | F.exists(keys, lambda k: k.rlike("(?i)^x-amz-(signature|algorithm)$"))
    signed = signed | (F.array_contains(keys, "AWSAccessKeyId") & F.array_contains(keys, "Signature"))
    if content_sha256 is not None:
        signed = signed | (F.coalesce(content_sha256, F.lit("")) != "")
    doing = F.when(method == "GET", "read").when(method == "HEAD", "check").when(method.isin("PUT", "POST"), "write").when(method == "DELETE", "delete").otherwise(method)
    part = lambda n: F.get(F.split(path, "/"), F.lit(n))

    def made(
        kind: str | Column, provider: Column, operation: Column, tables: Column | None = None, mode: Column = none, bucket: Column = none, shown: Column | None = None
    ) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        tables = F.array().cast("array<string>") if tables is None else tables
        place = F.when(host != "", host)
        return F.struct(
            kind.alias("kind"), provider.alias("provider"), operation.alias("operation"), place.alias("host"), (fn.safe_path(path) if shown is None else shown).alias("path"),
            local.alias("local"), tables.alias("tables"), mode.alias("mode"), bucket.alias("bucket"),
        )

    kinds = F.create_map(*[F.lit(x) for h, (k, _) in PROVIDERS.items() for x in (h, k)])
    names = F.create_map(*[F.lit(x) for h, (_, p) in PROVIDERS.items() for x in (h, p)])
    known, named = F.try_element_at(kinds, host), F.try_element_at(names, host)
    own = F.when(local, "local model").otherwise(F.concat(F.lit("compatible ("), host, F.lit(")")))
    virtual = F.regexp_extract(host, r"^(.+?)\.s3[.-]", 1)
    mode = F.when(authorization.rlike("(sk|rk)_test_"), "test").when(authorization.rlike("(sk|rk)_live_"), "live").otherwise("unknown")
    base = host.endswith(".supabase.co")
    rest = F.create_map(*[F.lit(x) for pair in REST_OPERATIONS.items() for x in pair])
    table = F.when(part(3) == "rpc", F.concat(F.lit("rpc:"), F.coalesce(part(4), F.lit("")))).otherwise(part(3))
    return (
        F.when(host == "", made("http", none, method, shown=F.lit("[invalid]")))
        .when((known == "ai") | compatible, made("ai", F.coalesce(named, own), path))
        .when(signed, made("files", F.lit("S3"), doing, bucket=F.when(virtual != "", virtual).otherwise(part(1))))
        .when(local, made("http", none, method))
        .when(known == "payment", made("payment", named, F.concat(method, F.lit(" "), path), mode=mode))
        .when(known.isNotNull(), made(known, named, F.concat(method, F.lit(" "), path)))
        .when(base & (part(1) == "rest") & (part(2) == "v1"), made("database", F.lit("Supabase"), F.coalesce(F.try_element_at(rest, method), method), F.array(table)))
        .when(base & (part(1) == "auth"), made("auth", F.lit("Supabase Auth"), part(3)))
        .when(base & (part(1) == "storage"), made("files", F.lit("Supabase Storage"), method, bucket=F.coalesce(part(4), part(3))))
        .when((host == "api.clerk.com") | host.endswith(".clerk.accounts.dev"), made("auth", F.lit("Clerk"), none))
        .otherwise(made("http", none, method))
    )


def boundary_key(step: DataFrame) -> DataFrame:
    """Adds key and weight to boundaries: what one step is, for comparing runs.

    step: kind, operation, tables, host, provider, local, and where they are known
    library, mode, bucket and path.  Calls to the own machine have no key and go.
    """
    def known(name: str) -> Column:
        return F.col(name).cast("string") if name in step.columns else F.lit(None).cast("string")

    tables = F.when(F.size("tables") > 0, F.array_join("tables", ", ")).otherwise("the database")
    op = F.upper(F.coalesce("operation", F.lit("")))
    db = (
        F.when(op.isin(*READS), F.concat(F.lit("db:read:"), tables)).when(op.isin(*STRUCTURE), F.concat(F.lit("db:structure:"), op, F.lit(":"), tables))
        .when(op.isin(*WRITES), F.concat(F.lit("db:write:"), op, F.lit(":"), tables)).otherwise(F.concat(F.lit("db:other:"), op, F.lit(":"), tables))
    )
    kind, unknown = F.col("kind"), F.lit("?")
    quiet_file = F.coalesce(F.col("operation").isin("read", "check"), F.lit(False))
    provider = F.coalesce(known("provider"), unknown)
    place = F.when(known("bucket").isNotNull(), F.concat(provider, F.lit(" "), known("bucket"))).otherwise(F.coalesce(known("provider"), known("path"), unknown))
    key = (
        F.when(kind == "database", db).when((kind == "http") & F.coalesce("local", F.lit(False)), None)
        .when(kind == "http", F.concat(F.lit("http:"), F.coalesce("host", unknown)))
        .when(kind == "ai", F.concat(F.lit("ai:"), provider))
        .when(kind.isin("email", "message", "auth"), F.concat(kind, F.lit(":"), F.coalesce(known("provider"), known("library"), unknown)))
        .when(kind == "payment", F.concat(F.lit("pay:"), provider, F.lit(":"), F.coalesce(known("mode"), F.lit(""))))
        .when((kind == "files") & quiet_file, F.concat(F.lit("file:read:"), place))
        .when(kind == "files", F.concat(F.lit("file:"), F.coalesce("operation", unknown), F.lit(":"), place))
        .otherwise(F.concat(kind, F.lit(":"), F.coalesce("operation", F.lit(""))))
    )
    info = ((kind == "database") & ~op.isin(*STRUCTURE) & ~op.isin(*WRITES)) | ((kind == "files") & quiet_file) | ~kind.isin("database", "http", "ai", "email", "message", "payment", "files")
    return step.withColumns({"key": key, "weight": F.when(info, "info").otherwise("warning")}).where("key IS NOT NULL")


def behaviour_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change: what one run of an action does and the other doesn't (after boundary_key)."""
    b, a = before.select("key").distinct(), after.select("key").distinct()
    gone = b.join(a, "key", "left_anti").select("key", F.lit("removed").alias("change"))
    return gone.union(a.join(b, "key", "left_anti").select("key", F.lit("added").alias("change")))


def effects(steps: DataFrame, by: str) -> DataFrame:
    """by, category, key, n, total: lasting effects of boundaries that didn't fail; a total is unknown if any amount is.

    Structure statements of a group count as one effect with their distinct tables.
    """
    rows = steps.where(~F.coalesce("error", F.lit(False)))
    op = F.upper(F.coalesce("operation", F.lit("")))
    table = F.when(F.size("tables") > 0, F.array_join("tables", ", ")).otherwise("?")
    none = F.col("affected") == 0
    category = (
        F.when((F.col("kind") == "database") & op.isin(*STRUCTURE), "structure").when((F.col("kind") == "database") & op.isin(*WRITES) & none, "no change")
        .when((F.col("kind") == "database") & op.isin(*WRITES), "database").when(F.col("kind").isin("email", "message"), "email").when(F.col("kind") == "payment", "payment")
        .when((F.col("kind") == "files") & ~op.isin("READ", "CHECK", "GET", "HEAD"), "files").when(F.col("kind") == "ai", "cost")
        .when((F.col("kind") == "http") & ~F.coalesce("local", F.lit(False)), F.when(op.isin("GET", "HEAD"), "outside read").otherwise("outside"))
    )
    key = F.when(category == "structure", "structure").when(category.isin("database", "no change"), F.concat(op, F.lit(":"), table)).otherwise(F.concat_ws(":", op, F.coalesce("host", "provider")))
    amount = F.when(category == "database", F.col("affected")).otherwise(F.lit(1).cast("long"))
    kept = rows.withColumns({"category": category, "key": key, "amount": amount}).where("category IS NOT NULL")
    grouped = kept.groupBy(by, "category", "key").agg(
        F.count("*").alias("n"), F.when(~F.bool_or(F.col("amount").isNull()), F.sum("amount")).alias("total"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tables")))).alias("tables"),
    )
    return grouped.withColumn("lasting", ~F.col("category").isin("no change", "outside read", "cost"))


def redo_plan(requests: DataFrame, by: str) -> DataFrame:
    """by, how, reason: whether an action can run again by itself; of several reasons the first in the order of the rules.

    requests: by, method, path, query_keys (array), other_origin; actions without a request have one row with a null path.
    """
    real = F.col("path").isNotNull()
    replayable = F.col("path").rlike(r"^/[A-Za-z0-9_./~-]*$") & ~F.col("path").contains(fn.MARK)
    grouped = requests.groupBy(by).agg(
        F.count_if(real).alias("n"), F.coalesce(F.bool_or(F.col("other_origin") & real), F.lit(False)).alias("other"),
        F.coalesce(F.bool_or(real & ~F.upper("method").isin(*RERUN)), F.lit(False)).alias("method"), F.coalesce(F.bool_or(real & (F.size("query_keys") > 0)), F.lit(False)).alias("query"),
        F.coalesce(F.bool_or(real & ~replayable), F.lit(False)).alias("path"),
    )
    reason = (
        F.when(F.col("n") == 0, "nothing").when(F.col("other"), "other-origin").when(F.col("method"), "method").when(F.col("query"), "query")
        .when((F.col("n") > MAX_REQUESTS) | F.col("path"), "path")
    )
    return grouped.select(by, F.when(reason.isNull(), "rerun").otherwise("by-hand").alias("how"), reason.alias("reason"))


def matched_requests(browser: DataFrame, server: DataFrame) -> DataFrame:
    """action, n, request_id, status: an action's requests with the server's, by action and number; either may be missing."""
    both = browser.select("action", "n", F.lit(True).alias("b")).join(server.select("action", "n", "request_id"), ["action", "n"], "full_outer")
    status = F.when(F.col("b").isNull(), "unmatched").when(F.col("request_id").isNull(), "not recorded").otherwise("matched")
    return both.select("action", "n", "request_id", status.alias("status"))


def frame_chain(frames: Column, root: str) -> Column:
    """The project's frames (file, line) of a browser stack, outermost first, without one that repeats the frame before it."""
    own = F.reverse(F.filter(frames, lambda f: f["file"].startswith(root) & ~f["file"].contains("/node_modules/")))
    return F.filter(own, lambda f, i: (i == 0) | ~(f == F.get(own, F.greatest(i - 1, F.lit(0)))))


def action_label(event: Column, tag: Column, name: Column) -> Column:
    """What was used, as shown: button “Sign in”."""
    kind = F.when(event == "submit", "form").when(tag == "a", "link").otherwise(F.coalesce(tag, F.lit("page")))
    return F.when(F.coalesce(name, F.lit("")) == "", kind).otherwise(F.concat(kind, F.lit(" “"), F.substring(name, 1, 120), F.lit("”")))


# Kinds of files that an assistant works on, by path, and their areas; the first rule that fits wins.
FILE_KINDS = [
    ("env", "configuration", r"(^|/)\.env[^/]*$"),
    ("lock", "configuration", r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|bun\.lockb?|poetry\.lock|uv\.lock)$"),
    ("dependencies", "configuration", r"(^|/)(package\.json|requirements\.txt|pyproject\.toml|Pipfile|go\.mod|Gemfile|Cargo\.toml)$"),
    ("test", "tests", r"\.(test|spec)\.[mc]?[jt]sx?$|(^|/)(test_[^/]*|[^/]*_test)\.(py|go)$|(^|/)(__tests__|tests?|e2e|cypress|playwright)/"),
    ("database", "database", r"\.(sql|prisma)$|(^|/)(migrations?|alembic|drizzle)/|(^|/)(schema|models?)\.(ts|js|py)$"),
    ("config", "configuration", r"(^|/)[^/]*\.(config|preset)\.[mc]?[jt]s$|(^|/)(tsconfig[^/]*|vercel|netlify)\.json$|\.(toml|ya?ml)$"),
    ("docs", "other", r"\.(mdx?|txt)$"),
    ("styles", "interface", r"\.(css|scss|sass|less)$"),
    ("route", "server", r"(^|/)route\.[mc]?[jt]s$|(^|/)pages/api/|(^|/)(api|routes|routers|endpoints|controllers|handlers)/.*\.([mc]?[jt]s|py)$"),
    ("page", "interface", r"(^|/)page\.[jt]sx?$|(^|/)(pages|views|screens)/.*\.(jsx|tsx|vue|svelte)$"),
    ("layout", "interface", r"(^|/)layout\.[jt]sx?$"),
    ("component", "interface", r"\.(jsx|tsx|vue|svelte|html)$"),
    ("data", "database", r"(^|/)(db|database|repositor(y|ies)|dal|data|models|prisma)/.*\.([mc]?[jt]s|py)$|(^|/)(db|database|prisma|supabase)\.[mc]?[jt]s$"),
    ("code", "server", r"\.([mc]?[jt]s|py|go|rb|rs|java|php)$"),
]
# Commands, what they do and where; the first rule that fits wins.
COMMANDS = [
    ("install", "configuration", r"^(npm|pnpm|yarn|bun|pip3?|uv|poetry|cargo|go) (i|install|add|ci|get|sync)\b"),
    ("test", "tests", r"^(npm|pnpm|yarn|bun) (run )?(test|t)\b|^(npx |pnpm exec )?(vitest|jest|playwright|pytest|mocha)\b|^(go|cargo) test\b|^python3? -m pytest\b"),
    ("build", "other", r"^(npm|pnpm|yarn|bun) run build\b|^(npx )?(tsc|vite build|next build)\b|^(cargo|go) build\b|^make\b"),
    ("lint", "other", r"^(npx )?(eslint|prettier|ruff|black|mypy|biome)\b|^(npm|pnpm|yarn|bun) run (lint|format|typecheck)\b"),
    ("start", "server", r"^(npm|pnpm|yarn|bun) (run )?(dev|start|serve)\b|^(uvicorn|flask|gunicorn|node|deno|python3?)\b"),
    ("database", "database", r"^(npx )?(prisma|drizzle-kit|supabase|alembic|psql|sqlite3|mysql)\b"),
    ("commit", "other", r"^git (commit|add|push|tag|merge|rebase)\b"), ("look", "look", r"^(git (status|diff|log|show|branch)|ls|cat|head|tail|rg|grep|find|pwd|wc|which|echo)\b"),
    ("remove", "other", r"^(rm|git rm)\b"), ("move", "other", r"^(mv|cp|mkdir|touch|git mv)\b"), ("fetch", "outside", r"^(curl|wget|gh|ssh)\b"),
]


def _first(value: Column, rules: list[tuple[str, str, str]], otherwise: tuple[str, str]) -> Column:
    out = F.struct(F.lit(otherwise[0]).alias("rule"), F.lit(otherwise[1]).alias("area"))
    for rule, area, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), F.struct(F.lit(rule).alias("rule"), F.lit(area).alias("area"))).otherwise(out)
    return out


def file_kind(path: Column) -> Column:
    """struct(rule, area) of a file that is worked on."""
    return _first(path, FILE_KINDS, ("other", "other"))


def command_kind(commands: Column) -> Column:
    """struct(rule, area) of a line's commands (array of words): the first one that does more than look, else the first."""
    each = F.transform(commands, lambda w: _first(F.array_join(w, " "), COMMANDS, ("unknown", "other")))
    acting = F.filter(each, lambda c: c["area"] != "look")
    return F.coalesce(F.get(acting, F.lit(0)), F.get(each, F.lit(0)))


def grouped_steps(rows: DataFrame, by: str, order: str, area: str) -> DataFrame:
    """by, step, area, n, first, last: adjacent actions of one area as one step, numbered in order."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(F.col(area).eqNullSafe(F.lag(area).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("step", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "step", F.col(area).alias("area")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def gestures(events: DataFrame, by: str, at_ms: str, kind: str) -> DataFrame:
    """events with gesture: an event joins the one before within 1000 ms if it is a submit, within 100 ms if it is of a label."""
    w = Window.partitionBy(by).orderBy(at_ms)
    since = F.col(at_ms) - F.lag(at_ms).over(w)
    joins = ((F.col(kind) == "submit") & (since <= 1000)) | ((F.col(kind) == "label") & (since <= 100))
    return events.withColumn("gesture", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def linked_sentences(sentences: DataFrame, hunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """sentence_id, file, hunk, via: where a sentence's change stands: a hunk around its line, its file's first hunk, or its block's.

    sentences: sentence_id, file, line, block; hunks: file, hunk, first, last; blocks: file, block.
    """
    s = sentences.select("sentence_id", "file", "line", "block")
    inside = s.join(hunks, "file").where((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last")))
    level = [inside.select("sentence_id", "file", "hunk", F.lit(0).alias("level"))]
    firsts = hunks.groupBy("file").agg(F.min("hunk").alias("hunk"))
    level.append(s.join(firsts, "file").select("sentence_id", "file", "hunk", F.lit(1).alias("level")))
    by_block = blocks.join(firsts, "file").groupBy("block").agg(F.min(F.struct("file", "hunk")).alias("f"))
    level.append(s.join(by_block, "block").select("sentence_id", "f.file", "f.hunk", F.lit(2).alias("level")))
    every = level[0].unionByName(level[1]).unionByName(level[2])
    best = every.groupBy("sentence_id").agg(F.min(F.struct("level", "file", "hunk")).alias("b"))
    via = F.get(F.array(F.lit("line"), F.lit("file"), F.lit("block")), F.col("b.level"))
    return s.select("sentence_id").join(best, "sentence_id", "left").select("sentence_id", "b.file", "b.hunk", F.coalesce(via, F.lit("none")).alias("via"))
