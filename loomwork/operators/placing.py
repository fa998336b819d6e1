"""Where files of a project run, and what they are by their facts and by what they import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import graphs
from loomwork.storage import checkpointed

# Languages of code that runs, and pages that a server renders and a browser takes over.
CODE = ("js", "jsx", "ts", "tsx", "vue", "svelte")
PAGES = r"^(src/)?pages/(?!api/)(?!_document\.)"


def where_files_run(files: DataFrame, imports: DataFrame, pages_router: bool = False) -> DataFrame:
    """path, runs_on (client, server or both) of code and HTML files.

    files: path, language, directives (array); imports: from, target, type_only.  The
    browser starts at the scripts of HTML pages, at 'use client' files and, with
    pages_router, at pages; what they import runs there too, up to 'use server' files.
    The server starts at all code that isn't the browser's and at rendered pages, and
    goes up to 'use client' files.  The second search needs the first one's result,
    so the two colours are searched one after the other, breadth first.
    """
    has = lambda d: F.coalesce(F.array_contains("directives", d), F.lit(False))
    code = F.col("language").isin(*CODE)
    rendered = code & F.col("path").rlike(PAGES) if pages_router else F.lit(False)
    marked = checkpointed(files.select("path", "language", code.alias("is_code"), has("use client").alias("client"), has("use server").alias("server"), rendered.alias("rendered")))
    links = imports.where("target IS NOT NULL AND NOT coalesce(type_only, false)").select(F.col("from").alias("src"), F.col("target").alias("dst")).distinct()

    def coloured(starts: DataFrame, wall: str, known: DataFrame | None) -> DataFrame:
        """What starts reach without entering files behind a wall; known: the only files there are."""
        walls = marked.where(wall).select("path")
        open_ = links.join(walls.withColumnRenamed("path", "dst"), "dst", "left_anti")
        starts = starts.join(walls, "path", "left_anti")
        if known is not None:
            open_ = open_.join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
            starts = starts.join(known, "path", "left_semi")
        return graphs.reachable(open_, starts.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))

    scripts = links.join(marked.where("language = 'html'").select(F.col("path").alias("src")), "src").select(F.col("dst").alias("path"))
    begun = scripts.union(marked.where("client OR rendered").select("path")).distinct()
    client = checkpointed(coloured(begun, "server", marked.where("is_code").select("path")).withColumn("in_client", F.lit(True)))
    others = marked.where("is_code").join(client, "path", "left").where("in_client IS NULL OR rendered").select("path")
    server = coloured(others, "client", None).withColumn("in_server", F.lit(True))
    both = marked.join(client, "path", "left").join(server, "path", "left")
    where = F.when(F.col("language") == "html", "client").when(F.col("in_client") & F.col("in_server"), "both").when(F.col("in_client"), "client").otherwise("server")
    return both.where("is_code OR language = 'html'").select("path", where.alias("runs_on"))


# Names of files, modules, calls, bases and decorators that tell what a Python file is.
META = (
    "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "Pipfile.lock", "poetry.lock", "uv.lock", "pdm.lock", "alembic.ini", "tox.ini", "pytest.ini", "mypy.ini",
    ".flake8", ".python-version", "runtime.txt", "MANIFEST.in", "noxfile.py",
)
DATABASE_MODULES = (
    "sqlalchemy", "flask_sqlalchemy", "sqlmodel", "psycopg", "psycopg2", "asyncpg", "aiosqlite", "sqlite3", "pymysql", "MySQLdb", "mysql", "pymongo", "motor", "mongoengine", "redis",
    "databases", "peewee", "tortoise", "supabase", "prisma",
)
DATABASE_OPENERS = (
    "create_engine", "create_async_engine", "sessionmaker", "async_sessionmaker", "scoped_session", "SQLAlchemy", "connect", "MongoClient", "AsyncIOMotorClient", "Redis", "from_url",
    "create_pool", "Database", "create_client", "Prisma",
)
SERVICE_MODULES = (
    "requests", "httpx", "aiohttp", "urllib3", "openai", "anthropic", "google", "mistralai", "groq", "cohere", "replicate", "stripe", "resend", "sendgrid", "postmark", "twilio", "boto3",
    "botocore", "cloudinary", "posthog", "sentry_sdk", "mixpanel", "algoliasearch", "mailgun", "smtplib",
)
MAIL_MODULES = ("flask_mail", "fastapi_mail", "emails", "yagmail", "aiosmtplib", "smtplib")
APPS = ("FastAPI", "Flask", "Starlette", "Quart")
ROUTE_VERBS = r"\.(get|post|put|patch|delete|options|head|route|api_route)$"
MODEL_BASES = r"(^|\.)(Base|Model|DeclarativeBase|SQLModel|Document)$"
HOOKS = r"\.(app_errorhandler|errorhandler|exception_handler|before_request|after_request|before_app_request|after_app_request|teardown_request|teardown_appcontext|middleware)$"
SEARCH = r"(?i)(^|\.)(elasticsearch|opensearch|meilisearch)(\.|$)"
#: The rule that a file gets for what it imports: it stands at this place in the order, and these rules make a file such a one.
NEIGHBOUR, DATA_RULES = ("data", "database-queries"), ("database-client", "python:models")
NO_PLACE = ("project-meta", "python:package-marker", "python:alembic-migration")


def python_profile(files: DataFrame, facts: DataFrame) -> DataFrame:
    """path, top, calls, bases, decorators, tables, is_empty, is_error: what the facts of each Python file (read_python) come to.

    Arrays are of distinct values, so a file's row is bounded by its text.
    """
    kind = F.col("kind")
    top = F.when((kind == "import") | ((kind == "from") & ~F.col("name").startswith(".")), F.substring_index("name", ".", 1))
    named = lambda k: F.when(kind == k, F.filter(F.split("detail", ","), lambda x: x != ""))
    found = facts.groupBy("path").agg(
        F.collect_set(top).alias("top"), F.collect_set(F.when(kind == "call", F.col("name"))).alias("calls"), F.array_distinct(F.flatten(F.collect_set(named("class")))).alias("bases"),
        F.array_distinct(F.flatten(F.collect_set(named("function")))).alias("decorators"), F.bool_or(kind == "table").alias("tables"),
        F.bool_or(kind == "empty").alias("is_empty"), F.bool_or(kind == "error").alias("is_error"),
    )
    none = F.array().cast("array<string>")
    joined = files.select("path").join(found, "path", "left")
    return joined.select("path", *[F.coalesce(c, none).alias(c) for c in ("top", "calls", "bases", "decorators")], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("tables", "is_empty", "is_error")])


def _python_rules(local: Column) -> list[tuple[str, str, Column]]:
    base = F.regexp_extract("path", r"[^/]*$", 0)
    folders = F.transform(F.slice(F.split(local, "/"), 1, F.greatest(F.size(F.split(local, "/")) - 1, F.lit(0))), F.lower)
    within = lambda *names: F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    imports = lambda names: F.arrays_overlap("top", F.array(*[F.lit(n) for n in names]))
    called = F.transform("calls", lambda c: F.substring_index(c, ".", -1))
    calls = lambda names: F.arrays_overlap(called, F.array(*[F.lit(n) for n in names]))
    decorated = lambda pattern: F.exists("decorators", lambda d: d.rlike(pattern))
    settings = F.exists("bases", lambda b: F.substring_index(b, ".", -1) == "BaseSettings")
    return [
        ("config", "python:package-marker", (base == "__init__.py") & F.col("is_empty")),
        ("tests", "test-file", base.rlike(r"^test_.*\.py$|_test\.py$|^conftest\.py$|^tests?\.py$") | within("tests", "test")),
        ("config", "project-meta", base.isin(*META)),
        ("data", "python:alembic-migration", within("migrations", "alembic") | imports(["alembic"])),
        ("config", "python:settings", settings | base.rlike(r"^(settings|config)\.py$") | within("config", "settings")),
        ("routes", "python:app-entry", calls(APPS)),
        ("routes", "python:routes", F.exists("decorators", lambda d: d.rlike(ROUTE_VERBS) & F.array_contains("calls", d))),
        ("routes", "python:request-hooks", decorated(HOOKS)),
        ("config", "python:cli", imports(["click", "typer"]) | decorated(r"\.cli\.(command|group)$")),
        ("routes", "python:blueprint", calls(["Blueprint", "APIRouter"])),
        ("routes", "folder:routers", within("routers", "routes", "api", "endpoints", "views", "blueprints", "controllers", "handlers")),
        ("data", "python:models", (F.col("tables") & F.exists("bases", lambda b: b.rlike(MODEL_BASES))) | base.rlike(r"^models?\.py$") | within("models")),
        ("data", "database-client", imports(DATABASE_MODULES) & calls(DATABASE_OPENERS)),
        (*NEIGHBOUR, F.col("by_neighbour")),
        ("data", "folder:data", within("db", "database", "repositories", "repository", "crud", "queries", "dal")),
        ("logic", "python:schemas", base.rlike(r"^schemas?\.py$") | within("schemas")),
        ("logic", "folder:services", within("services", "usecases", "use_cases", "domain", "actions")),
        ("utilities", "utilities", within("utils", "util", "helpers", "helper", "shared", "common") | base.rlike(r"(^|_)(utils?|helpers?)(_|\.py$)")),
        ("external", "outgoing-call", imports(SERVICE_MODULES)),
        ("external", "python:email", imports(MAIL_MODULES) | base.rlike(r"^(e?mails?|mailer)\.py$")),
        ("external", "python:search", F.exists("calls", lambda c: c.rlike(SEARCH))),
        ("config", "folder:scripts", local.rlike("^(scripts|bin|tools)/")),
        ("logic", "folder:lib", within("core", "lib", "logic", "modules", "features")),
    ]


def python_layers(profile: DataFrame, imports: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """path, block, rule, runs_on of Python files; the first rule that fits decides.

    profile: as python_profile gives it; imports: from, target.  Two passes: files that
    define the data are found first, then those that import one of them are known to
    query it, unless an earlier rule says what they are.  parts: folders that hold a
    part of the project; folder rules look at the path below the longest that fits.
    """
    local = F.col("path")
    for part in sorted(parts or [], key=len):  # the longest is asked first
        local = F.when(F.col("path").startswith(f"{part}/"), F.substring("path", len(part) + 2, 10_000)).otherwise(local)

    def decided(rows: DataFrame) -> DataFrame:
        out = F.struct(F.lit("unknown").alias("block"), F.lit("no-rule").alias("rule"))
        for block, rule, fits in reversed(_python_rules(local)):
            out = F.when(fits, F.struct(F.lit(block).alias("block"), F.lit(rule).alias("rule"))).otherwise(out)
        unread = F.struct(F.lit("unknown").alias("block"), F.lit("unreadable").alias("rule"))
        return rows.withColumn("as", F.when(F.col("is_error"), unread).otherwise(out))

    first = decided(profile.withColumn("by_neighbour", F.lit(False)))
    data = first.where(F.col("as.rule").isin(*DATA_RULES)).select(F.col("path").alias("target"))
    users = checkpointed(imports.select("from", "target").join(data, "target", "left_semi").select(F.col("from").alias("path")).distinct().withColumn("uses_data", F.lit(True)))
    second = decided(profile.join(users, "path", "left").withColumn("by_neighbour", F.coalesce("uses_data", F.lit(False))))
    where = F.when(~F.col("as.rule").isin(*NO_PLACE), "server")
    return second.select("path", "as.block", "as.rule", where.alias("runs_on"))
