"""Fill-in-middle rearrangement of texts, in Spark SQL functions only.

A text is cut into units, two cuts drawn from a hash of doc_id part it in prefix,
middle and suffix, and the three are put together behind sentinels.  restored()
takes the sentinels out again, from the output and its form alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
SALT = "1:"
#: Texts out of 100 that are rearranged, and of those rearranged the ones with the suffix first.
SHARE, SUFFIX_FIRST = 90, 20


def _draw(k: int, doc_id: Column, salt: str) -> Column:
    """The k-th number, from 1, of 8 hex digits in the hash of doc_id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, salt: str = SALT) -> DataFrame:
    """doc_id, text, n, form (plain, psm or spm), prefix, middle, suffix and output of every row.

    n is the number of units; prefix, middle and suffix are null in plain rows, whose
    output is the text.  Plain are empty texts, texts that hold a sentinel (they
    couldn't be restored) and the share that the hash leaves out.  A null text is an
    empty one; a null doc_id is hashed as no digits and stays null.  Equal rows give
    equal rows.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    one, two = (_draw(k, F.col("doc_id"), salt) % (F.col("n") + 1) for k in (1, 2))
    rows = rows.select("*", F.least(one, two).cast("int").alias("low"), F.greatest(one, two).cast("int").alias("high"))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("n") == 0) | held | (_draw(3, F.col("doc_id"), salt) % 100 >= share)
    first = _draw(4, F.col("doc_id"), salt) % 100 < suffix_first
    rows = rows.withColumn("form", F.when(plain, "plain").when(first, "spm").otherwise("psm"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    low, high = F.col("low"), F.col("high")
    rows = rows.select(
        "doc_id", "text", "n", "form", part(F.lit(1), low).alias("prefix"), part(low + 1, high - low).alias("middle"),
        part(high + 1, F.col("n").cast("int") - high).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from.

    The parts hold no sentinel and none can begin in a part and end in a sentinel, so
    the first of each is the one that was put in.
    """
    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        rest = F.substring_index(output, MIDDLE, 1)
        at = F.instr(rest, two)
        return (
            F.substring(rest, F.lit(1 + len(one)), at - 1 - len(one)),
            F.substring(rest, at + len(two), F.length(rest)),
            F.substring(output, F.length(rest) + 1 + len(MIDDLE), F.length(output)),
        )

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """Lengths and hashes of fill_in_middle, with the hash of what restored() gives back."""
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = f"""
WITH draws AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM draws
), cuts AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {SHARE} THEN 'plain'
         WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
    coalesce(array_to_string(units[low + 1:high], ''), '') AS middle, coalesce(array_to_string(units[high + 1:n], ''), '') AS suffix
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                   WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
