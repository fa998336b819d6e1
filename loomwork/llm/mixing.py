"""Mixing sources to target weights by iterative proportional fitting.

The table of tokens by source, language and topic is raked: factors of each
dimension in turn bring its marginal to the target, until all three agree.
Documents are then sampled with probabilities that keep the raked shares and
add up to the token budget.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import checkpointed

DIMENSIONS = ("source", "lang", "topic")
#: A target marginal is in proportion to tokens ** power: 1 leaves a dimension as it is, 0 makes its values equal.
POWER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP = 0.8
ROUNDS, CLOSE = 60, 1e-6


def tokens(text: Column) -> Column:
    """A count of tokens good enough for weights: bytes of UTF-8 over four, one at least."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) / 4), F.lit(1)).cast("double")


def topic(text: Column) -> Column:
    """A coarse topic from what a text holds; the first rule that fits."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(t.rlike("(?i)licen[sc]e|copyright"), "legal")
        .when(t.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]"), "contact")
        .when(t.rlike(r"[{}|;=<>]"), "markup")
        .when(F.length(t) >= 4000, "long prose")
        .when(F.length(t) >= 400, "prose")
        .otherwise("brief")
    )


@dataclass(frozen=True)
class Raked:
    """cells: source, lang, topic, tokens, weight (the raked share of all tokens); error: the largest difference of a marginal's share from its target."""

    cells: DataFrame
    error: float
    rounds: int


def shares(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """The target shares of a dimension's values, from their tokens."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    total = sums.agg(F.sum(F.pow("t", F.lit(power))).alias("t")).first()["t"]
    return sums.select(dimension, (F.pow("t", F.lit(power)) / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> Raked:
    """Weights of the cells whose marginals meet the targets (tables of a dimension's value and its share).

    cells has a row for each combination that occurs.  Sources may be very many: their
    factors stay in Spark, computed over the few cells of each source.  Languages and
    topics are short vocabularies: the table of the two is brought to its targets on the driver.
    """
    table = checkpointed(cells.join(targets["source"].withColumnRenamed("share", "aim"), "source"))
    aims = [{r[d]: r["share"] for r in targets[d].collect()} for d in ("lang", "topic")]
    factor = {(r["lang"], r["topic"]): 1.0 for r in table.select("lang", "topic").distinct().collect()}
    one_source = Window.partitionBy("source")
    error, done = 0.0, 0
    while True:
        done += 1
        factors = cells.sparkSession.createDataFrame([(*k, f) for k, f in sorted(factor.items())], "lang string, topic string, f double")
        scaled = table.join(F.broadcast(factors), ["lang", "topic"]).withColumn("x", F.col("tokens") * F.col("f"))
        weighed = scaled.withColumn("weight", F.col("aim") * F.col("x") / F.sum("x").over(one_source))
        now = {(r["lang"], r["topic"]): r["w"] for r in weighed.groupBy("lang", "topic").agg(F.sum("weight").alias("w")).collect()}
        gaps = []
        for place, aim in enumerate(aims):
            sums: dict[str, float] = {}
            for k in sorted(now):
                sums[k[place]] = sums.get(k[place], 0.0) + now[k]
            gaps += [abs(aim[v] - s) for v, s in sums.items()] if place == 0 else []
            for k in now:
                by = aim[k[place]] / sums[k[place]]
                now[k] *= by
                factor[k] *= by
            if place:
                gaps += [abs(aim[v] - s) for v, s in sums.items()]
        error = max(gaps)
        if error < CLOSE or done >= rounds:
            return Raked(checkpointed(weighed.select("source", "lang", "topic", "tokens", "weight")), error, done)


def _calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """cells with probability: min(1, scale * weight / tokens), with the scale at which expected tokens are the budget."""
    scale = budget
    for _ in range(40):
        p = F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens"))
        row = cells.agg(
            F.sum(F.when(p >= 1, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(p < 1, F.col("weight")).otherwise(0.0)).alias("open")
        ).first()
        if not row["open"] or row["open"] <= 0:
            break
        new = (budget - row["full"]) / row["open"]
        if abs(new - scale) <= 1e-9 * max(abs(scale), 1):
            break
        scale = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens")))


def mixed(documents: DataFrame, keep: float = KEEP, seed: int = 7, added: bool = False) -> DataFrame:
    """A sample of documents whose tokens by source, language and topic follow the raked targets.

    keep: the share of all tokens to aim at.  A row is drawn if a hash of its
    doc_id, as a number from 0 to 1, is under its cell's probability, so repeated
    rows are drawn or left together and a rerun draws the same ones; for a null
    doc_id, or without that column, the text is hashed.  A null source or language is a value of its own;
    null and empty texts weigh one token.  added: also topic, tokens and
    probability, in place of columns of these names.  Other columns stay as they are.
    Targets that contradict each other can't all be met: a warning gives the error then.
    An empty table gives an empty result.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    own = {d: topic(F.col("text")) if d == "topic" else key(d) for d in DIMENSIONS}
    by_text = F.xxhash64(F.lit(seed), "text")
    draw = F.when(F.col("doc_id").isNull(), by_text).otherwise(F.xxhash64(F.lit(seed), "doc_id")) if "doc_id" in documents.columns else by_text
    number = F.pmod(draw, F.lit(2**52)) / F.lit(2.0**52)
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), number.alias("number"), tokens(F.col("text")).alias("tokens"),
        *[v.alias(d) for d, v in own.items()],
    )
    cells = checkpointed(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    if cells.isEmpty():
        chosen = rows.withColumn("probability", F.lit(0.0))
    else:
        targets = {d: shares(cells, d, POWER[d]) for d in DIMENSIONS}
        total = cells.agg(F.sum("tokens").alias("t")).first()["t"]
        raked = rake(cells, targets)
        if raked.error >= CLOSE:
            warnings.warn(f"raking: marginals are {raked.error:.2g} off their targets after {raked.rounds} rounds", stacklevel=2)
        calibrated = checkpointed(_calibrated(raked.cells, keep * total))
        chosen = join_small(rows, calibrated.select(*DIMENSIONS, "probability"), list(DIMENSIONS))
    extra = ["topic", "tokens", "probability"] if added else []
    columns = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c not in extra]
    return chosen.where(F.col("number") < F.col("probability")).select(*columns, *extra)
