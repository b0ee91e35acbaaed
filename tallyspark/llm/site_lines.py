"""Operator 7, line dedup by site-relative frequency (DataFrame functions only).

Pages of one host are the rows with one ``host_col`` value; pages with equal
texts count once, so that copies of a page do not make all its lines look
like boilerplate.  A line (trimmed of spaces, not blank) is boilerplate on a
host if at least ``min_pages`` pages hold it and they are more than ``ratio``
of the host's pages.  Such lines go from every page of the host.  A page that
has no other line keeps its text: it is a frequent page, which is the
near-duplicate operator's business.

A null host is a host of its own, a null text stays null, blank lines stay,
repeated rows are treated alike, an empty table gives an empty one, texts are
split whole, and all other columns pass through; result columns whose name
the input has get a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import free, table

RATIO = 0.02
MIN_PAGES = 5


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): hashes of a host's boilerplate lines, at most
    (lines per page) / ratio of them, however many pages it has."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != ""))
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where("text is not null")
    # a null line stands for the page itself
    rows = pages.select("host", F.xxhash64("text").alias("page"), F.explode(
        F.concat(F.array(F.lit(None).cast("long")), F.transform(lines, lambda x: F.xxhash64(x)))).alias("line"))
    counts = rows.groupBy("host", "line").agg(F.count_distinct("page").alias("n"))
    counts = table(counts.where((F.col("n") >= min_pages) & F.col("line").isNotNull() | F.col("line").isNull()), "site-counts")
    total = counts.where("line is null").select(F.col("host").alias("of"), F.col("n").alias("total"))
    frequent = (counts.where("line is not null").join(total, F.col("host").eqNullSafe(F.col("of")))
                .where(F.col("n") > ratio * F.col("total")))
    return table(frequent.groupBy("host").agg(F.collect_list("line").alias("bad")), "site-lines")


def drop_site_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                    min_pages: int = MIN_PAGES, lines_out: str = "_lines", dropped_out: str = "_dropped") -> DataFrame:
    """``docs`` with the cleaned text and two counts: the text's non-blank
    lines, and how many of them went."""
    bad = boilerplate(docs, host_col, text_col, ratio, min_pages).select(F.col("host").alias("of"), "bad")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host_col).alias("host"),
                       F.split(F.col(text_col), "\n").alias("all"))
    shown = F.size(F.filter(F.col("all"), lambda x: F.trim(x) != ""))
    kept = F.when(F.col("bad").isNull(), F.col("all")).otherwise(
        F.filter("all", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("bad"), F.xxhash64(F.trim(x)))))
    some = F.exists("kept", lambda x: F.trim(x) != "")
    out = (rows.join(bad, F.col("host").eqNullSafe(F.col("of")), "left").withColumn("kept", kept)
           .withColumn("keep", F.when(some, F.col("kept")).otherwise(F.col("all"))))
    none = F.col("all").isNull()
    text = F.array_join("keep", "\n").alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns],
                      F.when(none, 0).otherwise(shown).cast("long").alias(free(docs, lines_out)),
                      F.when(none, 0).otherwise(F.size("all") - F.size("keep")).cast("long").alias(free(docs, dropped_out)))


ORACLE = f"""
WITH lines AS (
  SELECT source, text AS page, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line
  FROM documents WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(DISTINCT page) AS n FROM lines GROUP BY ALL),
total AS (SELECT source, count(DISTINCT text) AS total FROM documents GROUP BY source),
bad AS (SELECT c.source, c.line FROM counts c JOIN total t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.total),
host AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
docs AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS every, coalesce(h.bad, []) AS bad
  FROM documents d LEFT JOIN host h ON d.source IS NOT DISTINCT FROM h.source),
kept AS (SELECT *, list_filter(every, lambda x: trim(x) = '' OR NOT list_contains(bad, trim(x))) AS kept FROM docs),
final AS (SELECT *, CASE WHEN len(list_filter(kept, lambda x: trim(x) <> '')) > 0 THEN kept ELSE every END AS rest FROM kept)
SELECT doc_id, source, array_to_string(rest, chr(10)) AS text,
  CAST(coalesce(len(list_filter(every, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(every) - len(rest), 0) AS BIGINT) AS n_dropped
FROM final
"""
