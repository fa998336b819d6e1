"""Calls of language models: what they were asked and what they answered, whole or as streams of frames, in four dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a prompt or an answer that are kept.
EXCERPT = 200


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_text(value: Column) -> Column:
    return F.coalesce(F.to_json(value).startswith('"'), F.lit(False))


def _text(value: Column) -> Column:
    """A value that is a text, else null."""
    return F.when(_is_text(value), _at(value, "$", "string"))


def _there(value: Column) -> Column:
    """A value that is there and isn't a JSON null."""
    return F.when(value.isNotNull() & ~F.is_variant_null(value), value)


def excerpt(text: Column) -> Column:
    """The first characters of a text with single spaces; null for none."""
    plain = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, EXCERPT)
    return F.when(F.length(text) > 0, plain)


def _content_text(value: Column) -> Column:
    """A message's content: a text, or the texts of its parts with spaces between."""
    parts = _at(value, "$", "array<variant>")
    one = lambda p: F.coalesce(_text(p), _at(p, "$.text", "string"), _at(p, "$.input_text", "string"), F.lit(""))
    return F.coalesce(_text(value), F.array_join(F.transform(parts, one), " "))


def request_details(body: Column) -> Column:
    """struct(model, prompt, stream) of a request's JSON: prompt is the excerpt of the input, or of the last message of the user."""
    value = F.try_parse_json(body)
    given = F.coalesce(_there(_at(value, "$.messages")), _there(_at(value, "$.contents")), _there(_at(value, "$.input")))
    messages = _at(given, "$", "array<variant>")
    from_user = F.filter(messages, lambda m: F.coalesce(_at(m, "$.role", "string"), F.lit("user")) == "user")
    last = F.coalesce(F.try_element_at(from_user, F.lit(-1)), F.try_element_at(messages, F.lit(-1)))
    said = F.coalesce(_text(_at(value, "$.input")), _text(_at(value, "$.prompt")))
    prompt = F.coalesce(F.when(said != "", said), _content_text(_at(last, "$.content")), _content_text(_at(last, "$.parts")))
    streams = F.coalesce(F.to_json(_at(value, "$.stream")) == "true", F.lit(False))
    return F.struct(_text(_at(value, "$.model")).alias("model"), excerpt(prompt).alias("prompt"), streams.alias("stream"))


def frames(bodies: DataFrame) -> DataFrame:
    """call, seq, part, frame: the JSON frames of answers (call, seq, body).

    A body is JSON as a whole, or lines of an event stream of which those that begin with
    data: are frames.  A stream may come in many bodies, one after the other by seq.
    """
    whole = F.try_parse_json("body").isNotNull()
    lines = F.filter(F.split("body", "\n"), lambda x: x.startswith("data:"))
    cut = F.when(whole, F.array("body")).otherwise(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.substring(x, 6, 2**31 - 1), r"^\s+|\s+$", ""))))
    each = bodies.select("call", "seq", F.posexplode(cut).alias("part", "frame"))
    return each.where(F.try_parse_json("frame").isNotNull())


def _usage(value: Column) -> Column:
    """struct(input, output): tokens that a frame counts, by the names of either dialect."""
    held = F.coalesce(*[_there(_at(value, p)) for p in ("$.usage", "$.response.usage", "$.message.usage")])
    count = lambda v, *names: F.coalesce(*[_at(v, f"$.{n}", "bigint") for n in names])
    one, two = count(held, "input_tokens", "prompt_tokens"), count(held, "output_tokens", "completion_tokens")
    meta = _at(value, "$.usageMetadata")
    counted = one.isNotNull() | two.isNotNull()
    return F.struct(
        F.when(counted, one).otherwise(count(meta, "promptTokenCount")).alias("input"), F.when(counted, two).otherwise(count(meta, "candidatesTokenCount")).alias("output")
    )


def _answer(value: Column) -> Column:
    """The whole answer that a frame holds, if it holds one as a text."""
    first = lambda path, kind: F.try_element_at(F.filter(_at(value, path, "array<variant>"), lambda x: _at(x, "$.type", "string") == kind), F.lit(1))
    ways = [
        _at(value, "$.output_text"), _at(value, "$.choices[0].message.content"), _at(value, "$.choices[0].text"), _at(first("$.output", "message"), "$.content[0].text"),
        _at(first("$.content", "text"), "$.text"), _at(value, "$.candidates[0].content.parts[0].text"),
    ]
    return _text(F.coalesce(*[_there(w) for w in ways]))


def _delta(value: Column) -> Column:
    """The piece of an answer that a frame adds."""
    kind = _at(value, "$.type", "string")
    ways = [_at(value, "$.choices[0].delta.content"), F.when(kind == "response.output_text.delta", _at(value, "$.delta")), F.when(kind == "content_block_delta", _at(value, "$.delta.text"))]
    return _text(F.coalesce(*[_there(w) for w in ways]))


def response_details(rows: DataFrame) -> DataFrame:
    """call, input, output, answer of each call: the tokens last counted, and the excerpt of its answer.

    rows: call, seq, part, frame, as frames gives them.  A whole answer takes the place of
    all before it; pieces are added as long as the answer is shorter than the excerpt.  So
    of a call's frames at most EXCERPT come together, however long its stream: how much
    came before a piece is a running sum.
    """
    value = F.try_parse_json("frame")
    read = rows.select("call", F.struct("seq", "part").alias("at"), _usage(value).alias("usage"), _answer(value).alias("full"), _delta(value).alias("delta"))
    known = read.groupBy("call").agg(
        F.max_by("usage.input", F.when(F.col("usage.input").isNotNull(), F.col("at"))).alias("input"), F.max_by("usage.output", F.when(F.col("usage.output").isNotNull(), F.col("at"))).alias("output"),
        F.max(F.when(F.col("full").isNotNull(), F.struct("at", "full"))).alias("whole"),
    )
    order = Window.partitionBy("call").orderBy("at")
    lives = F.sum(F.col("full").isNotNull().cast("int")).over(order)
    pieces = read.where("full IS NOT NULL OR length(delta) > 0").withColumn("life", lives)
    pieces = pieces.withColumn("last", F.max("life").over(Window.partitionBy("call"))).where("life = last")
    mine = F.coalesce(F.length("full"), F.lit(0))
    before = F.coalesce(F.sum(mine + F.coalesce(F.length("delta"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + mine
    added = pieces.withColumn("before", before).where(F.col("before") < EXCERPT).where("length(delta) > 0")
    grown = added.groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "delta"))), lambda x: x["delta"]), "").alias("more"))
    both = known.join(grown, "call", "left")
    answer = F.concat(F.coalesce("whole.full", F.lit("")), F.coalesce("more", F.lit("")))
    return both.select("call", "input", "output", excerpt(answer).alias("answer"))
