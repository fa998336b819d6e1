"""Findings as they are shown: keys written in code, environment files that leak, smells in their order, texts with their words filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as fn

# Smells in the order in which they are shown, and environment files that are only examples.
SMELLS = ("cycle", "god-file", "large-file", "coupling", "dead-file", "unused-export", "duplicate")
EXAMPLE_ENV = r"(?i)\.(example|sample|template|dist|defaults)$"
ENV_FILE = r"(^|/)\.env[^/]*$"


def literal_keys(files: DataFrame) -> DataFrame:
    """path, line, kind of the keys that code has in it, never their values; one row for each kind and line.

    files: path, language, text.  Environment files are where keys belong and have no such findings.
    """
    code = files.where(F.coalesce(F.col("language") != "dotenv", F.lit(True)) & ~F.col("path").rlike(ENV_FILE))
    lines = code.select("path", F.posexplode(F.split("text", "\n")).alias("at", "said")).where(F.col("said").rlike(fn.KEY_BEGIN))  # one pattern for most lines
    kinds = [F.when(F.col("said").rlike(fn.ascii_bounds(shape)), kind) for kind, shape in fn.KEY_SHAPES.items()]
    kinds.append(F.when(fn.service_role(F.col("said")), "supabase-service-role"))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def env_files(files: DataFrame, tracked: DataFrame, ignored: DataFrame, has_git: bool = True) -> DataFrame:
    """path, kind of environment files that version control has, or would take: env-tracked, env-not-ignored, env-no-git.

    files, tracked and ignored: path.  Files that are examples by their name don't count.
    """
    env = files.select("path").distinct().where(F.col("path").rlike(ENV_FILE) & ~F.col("path").rlike(EXAMPLE_ENV))
    if not has_git:
        return env.select("path", F.lit("env-no-git").alias("kind"))
    known = env.join(tracked.select("path", F.lit(True).alias("tracked")).distinct(), "path", "left").join(ignored.select("path", F.lit(True).alias("ignored")).distinct(), "path", "left")
    kind = F.when(F.col("tracked"), "env-tracked").when(F.col("ignored").isNull(), "env-not-ignored")
    return known.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def ranked_smells(smells: DataFrame, most: int = 1000, kinds: tuple[str, ...] = SMELLS, off: tuple[str, ...] = ()) -> DataFrame:
    """smells with place: the first so many in the order of a report, without the kinds that are off.

    smells: kind, tokens, places, lines, certainty, file, line.  By kind, then the most
    copied tokens, the most lines, sure before possible, then the place.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    weight = F.coalesce("tokens", F.lit(0)) * F.coalesce("places", F.lit(1))
    order = [rank, F.desc(weight), F.desc(F.coalesce("lines", F.lit(0))), (F.col("certainty") != "sure").asc(), F.col("file"), F.col("line")]
    top = smells.where(~F.col("kind").isin(*off) if off else F.lit(True)).orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of so many rows at most


def health(smells: DataFrame, by: str) -> DataFrame:
    """by, kind, n, possible: how many smells of each kind there are, and how many of them may be none."""
    return smells.groupBy(by, "kind").agg(F.count("*").alias("n"), F.count_if(F.col("certainty") == "possible").alias("possible"))


def canonical(rows: DataFrame, proof: str = "proof") -> DataFrame:
    """rows with their proofs (structs of file and line) in order, so that the same content is the same row."""
    return rows.withColumn(proof, F.array_sort(proof))


def filled(one: Column, other: Column, words: Column, count: Column) -> Column:
    """A text with its holes {name} filled from a map in one pass: one if the count is 1, else other; unknown holes stay."""
    parts = F.regexp_extract_all(F.when(F.coalesce(count == 1, F.lit(False)), one).otherwise(other), F.lit(r"\{\w+\}|[^{]+|\{"), 0)

    def part(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\{(\w+)\}$", 1)
        return F.when((name != "") & F.map_contains_key(words, name), F.coalesce(F.try_element_at(words, name), F.lit("null"))).otherwise(p)

    return F.array_join(F.transform(parts, part), "")
