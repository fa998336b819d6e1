"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as fn
from loomwork.operators import structure
from loomwork.plans.registry import query, table

_BEARER = r"(?i)Bearer\s+[^\s""',;]+".replace('""', '"')


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""
WITH a AS (SELECT doc_id, text,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_sql(fn.BEARER)}', 'Bearer [REDACTED]', 'g'), '{_sql(fn.TOKEN_SHAPES)}', '[REDACTED]', 'g'),
  '{_sql(fn.ASSIGNMENT)}', '\\1[REDACTED]', 'g'), '{_sql(fn.EMAIL)}', '\\1***@\\2***', 'g') AS r FROM documents)
SELECT doc_id, sha256(r) AS redacted_sha256, r <> text AS redacted FROM a""")
def redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", fn.BEARER, f"Bearer {fn.MARK}")
    text = F.regexp_replace(text, fn.ascii_bounds(fn.TOKEN_SHAPES), fn.MARK)
    text = F.regexp_replace(text, fn.ASSIGNMENT, f"$1{fn.MARK}")
    text = F.regexp_replace(text, fn.EMAIL_ONCE, "$1$2***@$3***")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("redacted_sha256"), (text != F.col("text")).alias("redacted"))


@query()
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("r", fn.redact(F.col("text")))
    return rows.select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), F.octet_length("r").alias("bytes"), F.col("r").endswith("[TRUNCATED]").alias("truncated"))


def _shape_sql(kind: str, shape: str) -> str:
    """The lines with a shape; DuckDB has no lookahead, so the one shape that excludes a beginning is looked for where that beginning is broken."""
    line = "regexp_replace(t, '\\bsk-ant-', 'sk ant-', 'g')" if "(?!ant-)" in shape else "t"
    return f"SELECT '{kind}' AS kind, id, line FROM l WHERE regexp_matches({line}, '{_sql(shape.replace('(?!ant-)', ''))}')"


_JWT_SQL = f"regexp_extract(t, '{_sql(fn.JWT)}', 1)"
_PADDED = "rpad(translate(j, '-_', '+/'), CAST(ceil(length(j) / 4.0) AS INT) * 4, '=')"
_SHAPES = " UNION ALL ".join(_shape_sql(kind, shape) for kind, shape in fn.KEY_SHAPES.items()) + f"""
UNION ALL SELECT 'service-role', id, line FROM (SELECT id, line, {_JWT_SQL} AS j FROM l WHERE regexp_matches(t, '{_sql(fn.JWT)}'))
WHERE decode(from_base64({_PADDED})) LIKE '%"role":"service_role"%'"""
_LINES = """
WITH s AS (SELECT doc_id AS id, string_split(text, chr(10)) AS parts FROM documents UNION ALL SELECT 1000000000 + page_id, string_split(html, chr(10)) FROM pages),
l AS (SELECT id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS t FROM s)"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("id"), F.col("html").alias("text"))
    return docs.union(pages).select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "t"))


@query(f"{_LINES} SELECT kind, id, CAST(line AS BIGINT) AS line FROM ({_SHAPES})")
def key_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.when(F.col("t").rlike(fn.ascii_bounds(v)), k) for k, v in fn.KEY_SHAPES.items()]
    kinds = F.array_compact(F.array(*kinds, F.when(F.col("t").contains("eyJ") & fn.service_role(F.col("t")), "service-role")))
    # most lines have no beginning of a key: one search leaves them out before the shapes are tried
    likely = _numbered(spark, sf_dir).where(F.col("t").rlike(r"sk-|[sr]k_|whsec_|AKIA|ASIA|gh[pousr]_|github_pat_|xox|AIza|SG\.|PRIVATE KEY|eyJ"))
    return likely.select(F.explode(kinds).alias("kind"), "id", (F.col("at") + 1).cast("long").alias("line"))


@query(f"""{_LINES} SELECT id, CAST(line AS BIGINT) AS line, lower(regexp_extract(t, '(?i)(password|secret|token|api[ _-]?key|credential)\\s*[=:]\\s*[^\\s,;]+', 1)) AS name
FROM l WHERE regexp_matches(t, '(?i)(password|secret|token|api[ _-]?key|credential)\\s*[=:]\\s*[^\\s,;]+')""")
def assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"(?i)(password|secret|token|api[ _-]?key|credential)\s*[=:]\s*[^\s,;]+"
    rows = _numbered(spark, sf_dir).where(F.col("t").rlike(pattern))
    return rows.select("id", (F.col("at") + 1).cast("long").alias("line"), F.lower(F.regexp_extract("t", pattern, 1)).alias("name"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS masked, sha256(regexp_replace(text, '[0-9A-Za-z]', 'X', 'g')) AS masked_sha256 FROM documents""")
def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.length(F.regexp_replace("text", "[^0-9A-Za-z]", "")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked"), F.sha2(fn.mask_code(F.col("text")), 256).alias("masked_sha256"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_PATH = r"coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/')"


@query(f"""
WITH a AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, host, path, regexp_replace(trim(regexp_replace('&' || q, '&([^&=]*)(=[^&]*)?', '\\1 ', 'g')), ' +', ',', 'g') AS keys FROM a""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", fn.host_of(url).alias("host"), fn.path_of(url).alias("path"), F.array_join(fn.query_keys(url), ",").alias("keys")
    )


@query(f"""SELECT page_id, array_to_string([CASE WHEN regexp_matches(s, '^[0-9]+$|^[0-9a-fA-F]{{16,}}$') THEN ':id' ELSE s END FOR s IN string_split({_PATH}, '/')], '/') AS path FROM pages""")
def path_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.normal_path(fn.path_of(F.col("url"))).alias("path"))


# Example catalogue of hosts: exact names and suffixes.
_SERVICES = [("m.ththth.example.net", "maps"), ("*.example.net", "network"), ("*.example.org", "organisation"), ("ththre.example.com", "exact"), ("*.com", "commerce")]


@query(f"""
WITH c(host, service) AS (VALUES {", ".join(f"('{h}', '{s}')" for h, s in _SERVICES)}), p AS (SELECT page_id, {_HOST} AS h FROM pages)
SELECT page_id, h AS host, service FROM (
  SELECT page_id, h, service, row_number() OVER (PARTITION BY page_id ORDER BY host LIKE '*%', length(host) DESC) AS n
  FROM p LEFT JOIN c ON h = c.host OR c.host LIKE '*.%' AND h LIKE '%' || substr(c.host, 2)) WHERE n = 1""")
def host_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators.matching import by_host

    catalogue = spark.createDataFrame(_SERVICES, "pattern string, service string")
    pages = table(spark, sf_dir, "pages").select("page_id", fn.host_of(F.col("url")).alias("host"))
    return by_host(pages, catalogue, "page_id", "host")


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts FROM pages""")
def html_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).cast("long").alias("links"),
        F.regexp_count("html", F.lit("<script")).cast("long").alias("scripts"),
    )


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS t FROM documents WHERE text <> '')
SELECT doc_id, count(*) AS n_lines, count(DISTINCT t) AS n_distinct, max(length(t)) AS longest FROM l GROUP BY doc_id""")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text <> ''").withColumn("l", F.split(F.regexp_replace("text", "\n\\z", ""), "\n", -1))
    longest = F.array_max(F.transform("l", F.length)).cast("long")
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"), longest.alias("longest"))


@query("""

WITH p AS (SELECT source, doc_id // 512 AS part, count(*) AS n, sha256(string_agg(doc_id || chr(0) || sha256(text), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY ALL),
s AS (SELECT source, part // 512 AS part, sum(n) AS n, sha256(string_agg(part || chr(0) || h, chr(10) ORDER BY part)) AS h FROM p GROUP BY source, part // 512)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(part || chr(0) || h, chr(10) ORDER BY part)) AS content_hash FROM s GROUP BY source""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators.diffs import content_hashes

    return content_hashes(table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256)), "source", "doc_id", "hash", span=512)


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


@query("""
SELECT conv_id, turn, CASE WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') || '…' ELSE coalesce(array_to_string(w, ' '), '') END AS title FROM (
  SELECT conv_id, turn, list_filter(string_split(regexp_replace(CASE WHEN regexp_matches(t, '^.*?[.!?] ') THEN regexp_extract(t, '^(.*?[.!?]) ', 1) ELSE t END, '[.!?:;,]+$', ''), ' '), lambda x: x <> '') AS w
  FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'))""")
def prompt_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", fn.title(F.col("text")).alias("title"))


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY n) || CASE WHEN any_value(total) > 3 THEN ' and ' || (any_value(total) - 3) || ' more' ELSE '' END AS largest FROM r WHERE n <= 3 GROUP BY source""")
def largest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    top = rows.withColumn("n", F.row_number().over(w)).where("n <= 3")
    joined = top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]).alias("ids"))
    total = rows.groupBy("source").agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > 3, F.concat(F.lit(" and "), (F.col("total") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return joined.join(total, "source").select("source", F.concat(F.array_join("ids", ", "), more).alias("largest"))


@query("""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))
SELECT doc_id, count(DISTINCT s.g) AS shared, count(DISTINCT item_id) AS items FROM s JOIN t USING (g) GROUP BY doc_id""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.operators.matching import shared_shingles

    return shared_shingles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 8)


@query("""
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_distinct(w)) AS BIGINT) AS distinct_words, CAST(len([x FOR x IN w IF regexp_matches(x, '^[0-9]+$')]) AS BIGINT) AS numbers
FROM (SELECT doc_id, [x FOR x IN string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') IF x <> ''] AS w FROM documents)""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    numbers = F.size(F.filter("w", lambda x: x.rlike("^[0-9]+$")))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), numbers.cast("long").alias("numbers"))


@query(r"""
WITH d AS (SELECT doc, flatten([regexp_extract_all(x, '[A-Za-z0-9]+') FOR x IN ls]) AS w, flatten([[i FOR y IN regexp_extract_all(x, '[A-Za-z0-9]+')] FOR x, i IN ls]) AS n
  FROM (SELECT doc_id AS doc, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT doc, unnest(range(0, len(w) - 79)) AS pos, unnest([md5(array_to_string(w[i + 1:i + 80], ' ')) FOR i IN range(0, len(w) - 79)]) AS k FROM d WHERE len(w) >= 80),
f AS (SELECT doc, pos, min({'d': doc, 'a': pos}) OVER (PARTITION BY k) AS p FROM h),
m AS (SELECT p.d AS one, p.a AS one_at, doc AS two, pos AS two_at FROM f WHERE NOT (doc = p.d AND abs(pos - p.a) < 80)),
s AS (SELECT *, two_at - one_at AS shift, two_at - row_number() OVER (PARTITION BY one, two, two_at - one_at ORDER BY two_at) AS island FROM m),
r AS (SELECT one, two, CAST(min(one_at) AS INT) AS one_at, CAST(min(two_at) AS INT) AS two_at, count(*) + 79 AS length FROM s GROUP BY one, two, shift, island)
SELECT r.* FROM r JOIN d a ON a.doc = one JOIN d b ON b.doc = two WHERE a.n[one_at + length] - a.n[one_at + 1] >= 7 AND b.n[two_at + length] - b.n[two_at + 1] >= 7
  AND len([p FOR p IN range(1, length // 2 + 1) IF a.w[one_at + 1:one_at + length - p] = a.w[one_at + p + 1:one_at + length]]) = 0""")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = structure.lined_words(F.col("text"))
    return structure.copies(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), words.alias("w")).select("doc", "w.*"))


@query()
def copied_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = structure.lined_words(F.col("text"))
    return structure.duplicated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), words.alias("w")).select("doc", "w.*"))


# A document as a value: its text, its lines and what is deep in it.
@query("""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '[TRUNCATED ' || length(text) || ']' ELSE text END AS text, least(len(ls), 20) + CASE WHEN len(ls) > 20 THEN 1 ELSE 0 END AS items,
  CASE WHEN len(ls) > 20 THEN len(ls) - 20 END AS more, 'list (' || len(ls) || ')' AS deep FROM d""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwork.functions.preview import preview

    lines = F.split("text", "\n", -1)
    sizes = F.transform(lines, lambda x: F.length(x))
    value = F.to_json(F.struct("text", sizes.alias("lines"), F.struct(F.struct(F.struct(sizes.alias("d")).alias("c")).alias("b")).alias("a")))
    shown = table(spark, sf_dir, "documents").select("doc_id", preview(value).alias("p"))
    lists = F.from_json(F.get_json_object("p", "$.lines"), "array<string>")
    more = F.get_json_object(F.try_element_at(lists, F.lit(-1)), "$.$more").cast("long")
    return shown.select("doc_id", F.get_json_object("p", "$.text").alias("text"), F.size(lists).cast("long").alias("items"), more.alias("more"), F.get_json_object("p", "$.a.b.c.d['$type']").alias("deep"))
