"""Line dedup: windows of three lines that repeat anywhere are removed after their first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, free_name, quoted, staged

LINES = 3


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """`docs` with repeated passages removed from `text_col`, and two counts: lines before, and lines removed.

    Lines end at a line feed and are compared as they are. Every three consecutive lines make a window; windows overlap,
    and one of three blank lines counts for nothing. Of equal windows, in all documents, the first stays: by id (null
    ids last), repeated rows of an id in some order, then by position. The lines that any later occurrence covers go.
    A text of fewer than three lines stays as it is; a null text stays null, with 0 lines; a text may become empty.
    Columns of `docs` with the names of the two counts are replaced.

    Scale: windows go as 16-byte hashes. Counts and first places are aggregated before they shuffle. A window that
    makes up a thousandth of all windows or more is one of at most a thousand, so those are broadcast; the others are
    joined by shuffle. Texts shuffle once, to meet the positions that they lose.
    """
    row = free_name(docs, "row_")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    hashes = F.transform(F.split(text_col, "\n", -1), lambda x: F.when(x.rlike(f"^[{SPACE}]*$"), F.lit("")).otherwise(F.md5(x.cast("binary"))))
    lines = keyed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), hashes.alias("h")).filter(F.size("h") >= LINES)
    joined = lambda i: F.concat(*(F.get("h", i + k) for k in range(LINES)), *(F.when(F.get("h", i + k) == "", F.lit(f"b{k}")).otherwise("") for k in range(LINES)))
    window = F.transform(F.sequence(F.lit(0), F.size("h") - LINES), lambda i: F.when(F.concat(*(F.get("h", i + k) for k in range(LINES))) != "", F.unhex(F.md5(joined(i).cast("binary")))))
    windows = staged(lines.select("row", "doc_id", F.posexplode(window).alias("pos", "window")).filter("window is not null"), "windows")
    total = windows.count()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "pos")
    repeated = staged(windows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "repeated")
    repeated = repeated.select("window", "n", F.struct(F.col("first.row").alias("row"), F.col("first.pos").alias("pos")).alias("first"))
    often = max(1000, total // 1000)  # at most a thousand windows are as frequent
    known = windows.drop("doc_id").join(F.broadcast(repeated.filter(F.col("n") >= often).select("window", F.col("first").alias("hot"))), "window", "left")
    hot = known.filter("hot is not null").select("row", "pos", F.col("hot").alias("first"))
    cold = known.filter("hot is null").join(repeated.filter(F.col("n") < often).select("window", "first"), "window").select("row", "pos", "first")
    later = hot.unionByName(cold).filter((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    covered = later.groupBy("row").agg(F.collect_list("pos").alias("starts"))
    starts = free_name(docs, "starts_")
    covered = covered.select(F.col("row").alias(row), F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*(p + k for k in range(LINES)))))).alias(starts))
    out = keyed.join(covered, row, "left")
    split = F.split(text_col, "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(starts))
    text = F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stays, lambda i: F.get(split, i)), "\n"))
    columns = [text.alias(c) if c.lower() == text_col.lower() else quoted(c) for c in docs.columns if c.lower() not in (lines_col.lower(), removed_col.lower())]
    return out.select(*columns, F.coalesce(F.size(split), F.lit(0)).cast("long").alias(lines_col), F.coalesce(F.size(starts), F.lit(0)).cast("long").alias(removed_col))


#: Three lines as DuckDB text; `documents` may be replaced by another relation.
ORACLE = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS three
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l)),
v AS (SELECT doc_id, pos, list_transform(string_split(three, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '[\x20\x09-\x0D]*') THEN '' ELSE x END) AS three
      FROM w WHERE NOT regexp_full_match(three, '[\x20\x09-\x0D]*')),
n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY three ORDER BY doc_id, pos) AS nth FROM v),
c AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS gone FROM n WHERE nth > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: ls[i]), chr(10)) END AS text
FROM l LEFT JOIN c USING (doc_id)
"""
