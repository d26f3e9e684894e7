"""Fill-in-the-middle documents, cut and assembled in Columns by marker injection.

A delimiter is escaped in the text and appended after every unit, so counting it counts units and ``substring_index`` takes
the parts between two ranks; the parts are unescaped and put together in the order of the document's form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
PERCENT = 50  # of documents that are cut
SPM_PERCENT = 80  # of those, suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
# neither is white space, so escaping moves no unit's bounds
MARK, ESCAPE = "\x1e", "\x1f"


def _escaped(text: Column) -> Column:
    """Without ``MARK``; undone by ``_plain``."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "m"))


def _plain(part: Column) -> Column:
    """A part of the marked text as it was. Every ``ESCAPE`` there is followed by its own letter, so the order of the two is free of doubt."""
    return F.replace(F.replace(F.replace(part, F.lit(MARK)), F.lit(ESCAPE + "m"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _part(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(MARK), count.cast("int"))


def with_infill(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with all its columns and ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, a row for each row.

    A unit is a run of white space with the word after it; white space at the end is one unit. The cuts and the form follow
    from the sha256 of seed and id alone, so repeats of an id have the same draws, and a null id draws as an empty one. Null texts are
    empty ones; an empty text and one that holds one of the three markers stay plain, with null lengths of parts. Texts are cut as a
    whole, however long. The five names given are taken: columns of ``docs`` with these names are replaced, all others kept.
    An empty table gives no rows.
    """
    own = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [c for c in docs.columns if c not in own]
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept) if kept else [F.lit(0)]).alias("row"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"), drawn.alias("drawn"))

    def draw(i: int) -> Column:
        return F.conv(F.substring("drawn", 8 * i + 1, 8), 16, 10).cast("long")

    marked = rows.withColumn("marked", F.regexp_replace(_escaped(F.col("text")), UNIT, "$0" + MARK))
    counted = marked.withColumn("n", F.length("marked").cast("long") - F.length(F.replace("marked", F.lit(MARK))))
    holds = reduce(Column.__or__, (F.contains(F.col("text"), F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)))
    cuts = [draw(i) % (F.col("n") + 1) for i in range(2)]
    formed = counted.select(
        "row", "text", "marked", "n", F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"),
        F.when((F.col("text") == "") | holds | (draw(2) % 100 >= percent), "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    a, b, n, whole = F.col("a"), F.col("b"), F.col("n"), F.col("marked")
    cut = F.col("form") != "plain"
    parts = formed.select(
        "row", "text", "n", "form", F.when(cut, _plain(_part(whole, a))).alias("prefix"), F.when(cut, _plain(_part(_part(whole, b), a - b))).alias("middle"),
        F.when(cut, _plain(_part(whole, b - n - 1))).alias("suffix"),
    )
    put = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    return parts.select(
        *(F.col(f"row.`{c}`").alias(c) for c in kept), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.coalesce(put, "text").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text cut, and rebuilt from what came out."""
    made = with_infill(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_UNIT_SQL = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '{_UNIT_SQL}') AS units FROM d),
k AS (SELECT *, len(units) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM u),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR r[3] % 100 >= {PERCENT} THEN 'plain'
       WHEN r[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
