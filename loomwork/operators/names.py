"""What names in modules mean: own symbols, imported ones, and what files export again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.storage import written


#: Rows of a task's share of a side that is held as a hash table, on average at most; beyond that both sides are sorted.
HASHED_ROWS = 2**20


def _hashed(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join whose keys are distinct: looked up without sorting where so many rows, dealt out, fit a task."""
    return df.hint("shuffle_hash") if rows <= HASHED_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _listed(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """id, path, name, is_symbol, listed, source, from_name, symbol: each name that a file exports or has as a symbol, with a number.

    Of several exports under one name the first counts; a name that is no export has listed false.
    """
    first = F.struct(F.col("source").isNull().alias("no_source"), "source", F.coalesce("source_name", "name").alias("from_name"), F.coalesce("local", "name").alias("symbol"))
    rows = exports.select("path", "name", F.lit(False).alias("is_symbol"), first.alias("e"))
    rows = rows.unionByName(symbols.select("path", "name", F.lit(True).alias("is_symbol")), allowMissingColumns=True)
    each = rows.repartition("path", "name").groupBy("path", "name").agg(F.min("e").alias("e"), F.max("is_symbol").alias("is_symbol"))
    return written(each.select(F.monotonically_increasing_id().alias("id"), "path", "name", "is_symbol", F.col("e").isNotNull().alias("listed"), "e.source", "e.from_name", "e.symbol"), "names")


def _looked_up(plain: DataFrame, names: DataFrame, bindings: DataFrame) -> DataFrame:
    """use_id, path, name, id, exported, is_symbol, target, imported: plain uses, and locals that are exported, which mean what a use in their file means.

    A row has is_symbol, or target and imported, or nothing where the file doesn't know the name; of exports id and exported are not null.
    """
    local = names.where("listed AND source IS NULL").select("path", F.col("symbol").alias("name"), "id", F.col("name").alias("exported"))
    asked = plain.select("use_id", "path", "name").unionByName(local, allowMissingColumns=True)
    own = names.where("is_symbol").select("path", "name", "is_symbol")
    bound = bindings.where("target IS NOT NULL AND imported <> '*'").repartition("path", "local").groupBy("path", F.col("local").alias("name")).agg(F.min(F.struct("target", "imported")).alias("b"))
    met = asked.join(own, ["path", "name"], "left").join(bound, ["path", "name"], "left").where("id IS NOT NULL OR is_symbol OR b IS NOT NULL")
    return written(met.select("use_id", "path", "name", "id", "exported", F.coalesce("is_symbol", F.lit(False)).alias("is_symbol"), "b.target", "b.imported"), "looked_up")


def _meanings(names: DataFrame, met: DataFrame) -> DataFrame:
    """path, name, end_path, symbol, listed: the symbol behind a name that another file takes from a file.

    Links from name to name go by number.  Pointers double each round; only names whose end isn't known
    yet are written anew, and look theirs up among all.
    """
    exported = met.where("id IS NOT NULL")
    plain = exported.where("is_symbol").select("path", F.col("exported").alias("name"), F.col("path").alias("end_path"), F.col("name").alias("symbol"), F.lit(True).alias("listed"))
    # A name that its file doesn't list as an export may still be a symbol of it.
    unlisted = names.where("is_symbol AND NOT listed AND name <> 'default'").select("path", "name", F.col("path").alias("end_path"), F.col("name").alias("symbol"), "listed")
    ends = plain.unionByName(unlisted)
    links = names.where("source IS NOT NULL").select("id", "path", "name", F.col("source").alias("to_path"), F.col("from_name").alias("to_name")).unionByName(
        exported.where("NOT is_symbol AND target IS NOT NULL").select("id", "path", F.col("exported").alias("name"), F.col("target").alias("to_path"), F.col("imported").alias("to_name"))
    )
    met_there = links.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), F.col("id").alias("to")).unionByName(
        ends.select(F.col("path").alias("to_path"), F.col("name").alias("to_name"), "end_path", "symbol"), allowMissingColumns=True
    )
    rows = names.count()
    at = written(links.join(_hashed(met_there, rows), ["to_path", "to_name"], "left").select("id", "path", "name", "to", "end_path", "symbol"), "links")
    known = reached = at.where("to IS NULL")
    before = None
    while True:
        moving = at.where("to IS NOT NULL")
        left = moving.count()
        if left in (0, before):  # each round ends part of every chain that ends at all: what is left goes round
            break
        there = known.select("id", "to", "end_path", "symbol").unionByName(moving.select("id", "to", "end_path", "symbol")).select(F.col("id").alias("to"), F.col("to").alias("next"), "end_path", "symbol")
        at = written(moving.select("id", "path", "name", "to").join(_hashed(there, rows), "to").select("id", "path", "name", F.col("to").alias("through"), F.col("next").alias("to"), "end_path", "symbol"), "links")
        ended, before = at.where("to IS NULL"), left
        # What still moves is led to what moved in this round, or to where a name that ended in it was led.
        known = ended.select("id", "to", "end_path", "symbol").unionByName(ended.select(F.col("through").alias("id"), "to", "end_path", "symbol").dropDuplicates(["id"]))
        reached = reached.unionByName(ended.drop("through"))
    return ends.unionByName(reached.where("end_path IS NOT NULL").select("path", "name", "end_path", "symbol", F.lit(True).alias("listed")))


def export_ends(symbols: DataFrame, exports: DataFrame, bindings: DataFrame) -> DataFrame:
    """path, name, end_path, symbol: the symbol behind each name that a file exports, through files that export it again.

    symbols: path, name; exports: path, name, local (null: the name itself), source and
    source_name (null, or what the export takes from another file); bindings: path,
    local, imported, target.  An exported local that is itself imported leads on to
    the file it comes from.  Pointers double each round, so a chain of n files takes
    log2(n) rounds; names that only lead to each other have no end and give no row.
    """
    names = _listed(symbols, exports)
    plain = names.where(F.lit(False)).select(F.lit(None).cast("long").alias("use_id"), "path", "name")
    return _meanings(names, _looked_up(plain, names, bindings)).where("listed").drop("listed")


def resolved_names(uses: DataFrame, symbols: DataFrame, exports: DataFrame, bindings: DataFrame) -> DataFrame:
    """use_id, path, symbol, via of the uses whose name is known: own, imported or namespace.

    uses: use_id, path, name, object (null, or the local name that the name is taken from).
    A file's own symbol comes before an imported one; object.name needs object to be a
    namespace (imported '*'), or a default import of a file that gives the name the
    CommonJS way (exports has common_js).
    """
    uses = uses.select("use_id", "path", "name", "object")
    names = _listed(symbols, exports)
    met = _looked_up(uses.where("object IS NULL"), names, bindings)
    asked = met.where("id IS NULL")
    own = asked.where("is_symbol").select("use_id", "path", F.col("name").alias("symbol"), F.lit("own").alias("via"))
    imported = asked.where("NOT is_symbol").select("use_id", F.col("target").alias("path"), F.col("imported").alias("name"), F.lit("imported").alias("via"))
    whole = bindings.where("target IS NOT NULL").select("path", F.col("local").alias("object"), "imported", "target")
    spaced = uses.where("object IS NOT NULL").join(whole, ["path", "object"])
    if "common_js" in exports.columns:
        given = exports.where("common_js").select(F.col("path").alias("target"), "name").distinct().withColumn("given", F.lit(True))
        spaced = spaced.join(given, ["target", "name"], "left").where("imported = '*' OR (imported = 'default' AND given)")
    else:
        spaced = spaced.where("imported = '*'")
    spaced = spaced.groupBy("use_id", "name").agg(F.min("target").alias("path")).select("use_id", "path", "name", F.lit("namespace").alias("via"))
    found = imported.unionByName(spaced).join(_hashed(_meanings(names, met), names.count()), ["path", "name"])
    return own.unionByName(found.select("use_id", F.col("end_path").alias("path"), "symbol", "via"))


def linked_calls(calls: DataFrame, symbols: DataFrame, exports: DataFrame, bindings: DataFrame) -> DataFrame:
    """caller, path, symbol, n: the project's functions that each caller calls directly; variables are no functions.

    calls: caller, path, name, object; symbols: path, name, kind.
    """
    rows = written(calls.withColumn("use_id", F.monotonically_increasing_id()), "calls")
    found = resolved_names(rows, symbols, exports, bindings)
    functions = symbols.where("kind <> 'variable'").select("path", F.col("name").alias("symbol")).distinct()
    met = found.join(functions, ["path", "symbol"], "left_semi").join(rows.select("use_id", "caller"), "use_id")
    return met.groupBy("caller", "path", "symbol").agg(F.count("*").alias("n"))
