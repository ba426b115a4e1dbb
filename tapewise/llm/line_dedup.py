"""Boilerplate lines by their relative frequency within a site, in DataFrame operations only.

Lines are grouped by host. A line is boilerplate on a host when it stands on more
than ``ratio`` of the host's pages and on at least ``min_pages`` of them; it is then
dropped from every page of that host. Lines are compared without surrounding white
space; blank lines are always kept. Pages of a host with the same text are one page
in these counts, so that a text copied often doesn't count as boilerplate itself and
lose all its lines; ``copies_once=False`` counts every row, as the SQL below does.

The lines of a host above the ratio are few whatever the host's size: the shares of
all its distinct lines add up to its lines per page, so at most (lines per page) /
ratio of them can pass. Where all lists together are short they go to every task; longer
ones are joined to the pages in parts, so pages of a hot host spread over many tasks. Line
counts are summed before their shuffle.

Cases: a null host is a site of its own; null text stays null and its page counts;
a text whose lines all go becomes empty; a line repeated on a page counts once;
null texts of a host are one page with ``copies_once``; extra columns pass through
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.session import staged

RATIO = 0.1
MIN_PAGES = 4
#: Keys of lines that may be sent to every task: eight bytes each.
BROADCAST_LINES = 500_000
#: Pages of a host that share one copy of its list where lists are joined.
PAGES_A_PART = 20_000


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, for tables of web pages."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def bare_line(line: Column) -> Column:
    """A line as it is compared: tabs and carriage returns count as spaces, none at the ends."""
    return F.trim(F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")), F.translate(line, "\r\t", "  ")).otherwise(line))


def line_keys(text: Column) -> Column:
    """Hashes of the distinct lines of a text that aren't blank.

    With 64 bits, the chance that some line of a site meets one of its boilerplate lines is
    their numbers' product over 2 ** 64.
    """
    bare = F.array_remove(F.transform(F.split(text, "\n", -1), bare_line), "")
    return F.array_distinct(F.transform(bare, lambda x: F.xxhash64(x)))


def frequent_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = True) -> DataFrame:
    """Rows (host, drop, pages): the keys of each host's boilerplate lines, and the number of its pages."""
    keyed = pages.select(F.col(host).alias("_host"), line_keys(F.col(text)).alias("_keys"))
    own = pages.select(F.col(host).alias("_host"))
    if copies_once:
        same = [F.col(host).alias("_host"), F.xxhash64(text).alias("_ta"), F.hash(F.col(text), F.lit(7)).alias("_tb"), F.length(text).alias("_tn")]
        own = pages.select(*same).distinct()
        keyed = pages.select(*same, line_keys(F.col(text)).alias("_keys")).groupBy("_host", "_ta", "_tb", "_tn").agg(F.first("_keys").alias("_keys"))
    counts = (keyed.select("_host", F.explode("_keys").alias("_line"))
              .groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages))
    totals = own.groupBy("_host").agg(F.count("*").alias("_pages"))
    c, t = counts.alias("c"), totals.alias("t")
    return (c.join(t, F.col("c._host").eqNullSafe(F.col("t._host")))
            .where(F.col("_n") > F.col("_pages") * F.lit(ratio))
            .groupBy(F.col("c._host").alias("_host")).agg(F.collect_list("_line").alias("_drop"), F.max("_pages").alias("_pages")))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: bool = False, counted: str | None = None, copies_once: bool = True,
                     broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text``.

    With ``counts``, the columns n_lines and n_dropped are added. ``counted`` names a
    column that holds the text's length, and is set anew where lines went. Without
    ``copies_once``, pages of a host with the same text count separately.

    The lists are written first and their size is read: at most ``broadcast_lines`` keys go
    to every task, so that no text is shuffled. Longer lists are joined by host and a part
    of the host's pages, in as many parts as the largest host has ``PAGES_A_PART`` pages.
    """
    known = staged(frequent_lines(pages, host, text, ratio, min_pages, copies_once))
    size = known.agg(F.sum(F.size("_drop")).alias("lines"), F.max("_pages").alias("pages")).first()
    small = known.select(F.col("_host").alias("_known"), "_drop")
    if (size["lines"] or 0) <= broadcast_lines:
        j = pages.join(F.broadcast(small), F.col(host).eqNullSafe(F.col("_known")), "left")
    else:
        parts = -(-size["pages"] // PAGES_A_PART)
        salt = F.pmod(F.xxhash64(F.col(text), *[F.col(c) for c in pages.columns if c.endswith("_id")]), F.lit(parts))
        j = pages.withColumn("_salt", salt).join(
            small.withColumn("_grain", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))),
            F.col(host).eqNullSafe(F.col("_known")) & (F.col("_salt") == F.col("_grain")), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), F.xxhash64(bare_line(x))))  # blank lines are in no list
    out = j.withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
    extra = []
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long")
        left = F.when(F.col(text).isNull() | F.col("_drop").isNull(), n).otherwise(F.size("_kept").cast("long"))
        extra = [n.alias("n_lines"), (n - left).alias("n_dropped")]
    clean = F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")).alias(text)
    length = F.when(F.col("_drop").isNull(), F.col(counted)).otherwise(F.length(F.array_join("_kept", "\n"))) if counted else None
    new = {text: clean} | ({counted: length.cast(pages.schema[counted].dataType).alias(counted)} if counted else {})
    return out.select(*[new.get(c, F.col(c)) for c in pages.columns], *extra)


SQL = rf"""
WITH l AS (SELECT doc_id, source, i, x, trim(translate(x, chr(13) || chr(9), '  ')) AS k
           FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
n AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM l WHERE k <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
d AS (SELECT n.source, k FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE)),
m AS (SELECT l.*, d.k IS NOT NULL AS gone FROM l LEFT JOIN d ON l.source IS NOT DISTINCT FROM d.source AND l.k = d.k),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS s FROM m GROUP BY 1)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE a.s END AS text,
       CAST(coalesce(a.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.g, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN a USING (doc_id)"""
