"""Line deduplication across a corpus, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import cut, spread_join

_SPACE = " \t\n\x0b\x0c\r"


def _hashed(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of each line whose key is long enough; h1 and h2 are 128 bits of the key."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return (
        lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(_SPACE)).alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .select(
            "doc_id", "row", "pos", F.translate("line", string.ascii_uppercase, string.ascii_lowercase).alias("key")
        )
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def dedupe_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text (what is kept), n_lines, n_dropped for each row of `docs`, and its columns `carry` in a struct.

    A line's key is the line without ASCII white space at its ends, A-Z folded.  Keys of `min_chars` code points
    or more found in `min_docs` documents or more lose all their lines but those of the largest doc_id that
    holds the key; the other lines are joined again in their order.

    A null or empty text is one empty line and stays the empty text.  Rows with one doc_id are one document in
    the counts, and each keeps a result row.  Rows with a null doc_id belong to no document: they are not
    counted and lose nothing.  Very long texts are split whole; ties can't be, as ids are told apart.  An empty table gives an empty result; other columns are not read.
    """
    carried = F.struct(*carry) if carry else F.lit(None)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried")
    ).withColumn("row", F.xxhash64("text"))
    lines = cut(_hashed(rows.filter("doc_id IS NOT NULL"), min_chars), "lines")
    # The documents of a key are made distinct before they are counted, so that a line that a third of all
    # documents hold is aggregated by (key, document) first and never gathered anywhere.
    frequent = cut(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("holder"), F.count("*").alias("n"))
        .filter(F.col("docs") >= min_docs)
        .drop("docs"),
        "frequent-lines",
    )
    # A line that a third of all documents hold is joined in several tasks.
    drops = (
        spread_join(lines, frequent, ["h1", "h2"])
        .filter("doc_id <> holder")
        .distinct()
        .groupBy("doc_id", "row")
        .agg(F.collect_list("pos").alias("drops"))
    )
    kept = F.expr(
        "element_at(transform(array(split(text, '\\n', -1)), ls -> array_join(transform("
        "array_except(sequence(0, size(ls) - 1), drops), i -> get(ls, i)), '\\n')), 1)"
    )
    return rows.join(drops, ["doc_id", "row"], "left").select(
        "doc_id",
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("text"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
        .cast("long")
        .alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        *(["carried"] if carry else []),
    )


#: DuckDB SQL for the query op10.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.holder AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
