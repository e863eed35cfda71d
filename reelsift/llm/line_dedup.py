"""Line dedup by site-relative frequency (operator 10), in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import stored

#: A line is boilerplate on a host if it is on more than RATIO of the host's pages; a line on one page alone is no repeat.
RATIO, MIN_PAGES = 0.1, 2
#: Keys that may be broadcast: 16 bytes each and the host's name. Beyond it they are joined by a shuffle, each host in SALTS parts.
BROADCAST_KEYS, SALTS = 200_000, 64


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case; for a column that names a site already, use the column."""
    return F.lower(F.parse_url(url, F.lit("HOST")))


def line_key(line: Column) -> Column:
    """128 bits that stand for a line without the white space around it."""
    x = F.trim(line)
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x, F.length(x)).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, key, pages and share of each boilerplate line; ``pages`` has host and lines (array).

    A page counts once for a line however often it repeats it. Blank lines are no boilerplate. With a mean of L lines a
    page, a host has at most L / ratio boilerplate lines, so their keys fit in one row.
    """
    each = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), line_key))).alias("key"))
    counts = each.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    share = F.col("pages") / F.col("total")
    return counts.join(totals, "host").withColumn("share", share).where(F.col("share") > ratio).select("host", "key", "pages", "share")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with ``text`` less the boilerplate lines of their host, and n_lines and n_dropped.

    Lines are what line feeds separate, compared without spaces around them; the lines that stay keep their bytes and order.
    A null text stays null and has no lines; an empty one has one blank line. Null hosts form one host. A page of nothing but
    boilerplate gets an empty text. Rows that repeat are pages each. An empty table gives an empty result; all other columns
    of docs are kept whatever their names (n_lines and n_dropped are replaced).
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.split(F.col(text), "\n", -1).alias("lines"))
    found = stored(boilerplate(packed, ratio, min_pages), "boilerplate")
    keys = found.groupBy("host").agg(F.collect_list("key").alias("keys"))
    if found.count() <= broadcast_keys:
        rows = packed.join(F.broadcast(keys), "host", "left")
    else:
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = packed.withColumn("salt", F.pmod(F.hash("lines"), F.lit(SALTS))).join(keys, ["host", "salt"], "left")
    # Which of the host's keys a page has at all is found through a hash set of their first halves.
    hits = F.array_intersect(F.transform("lines", lambda x: line_key(x).a), F.transform("keys", lambda k: k.a))
    rows = rows.withColumn("hits", F.when(F.col("keys").isNotNull(), hits))
    drop = lambda x: (F.trim(x) != "") & F.array_contains("hits", line_key(x).a) & F.array_contains("keys", line_key(x))
    rows = rows.withColumn("kept", F.when(F.coalesce(F.size("hits"), F.lit(0)) > 0, F.filter("lines", lambda x: ~drop(x))).otherwise(F.col("lines")))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*[F.array_join("kept", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def line_dedup_sql(docs: str = "documents") -> str:
    """The same in DuckDB: doc_id, n_lines, n_dropped and text."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM {docs}),
l AS (SELECT r, coalesce(source, chr(1)) AS host, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
t AS (SELECT coalesce(source, chr(1)) AS host, count(*) AS total FROM d GROUP BY 1),
b AS (SELECT l.host, trim(line, ' ') AS line FROM l JOIN t ON l.host = t.host WHERE trim(line, ' ') <> '' GROUP BY 1, 2, total
  HAVING count(DISTINCT r) >= {MIN_PAGES} AND count(DISTINCT r) / total > {RATIO}),
k AS (SELECT r, count(*) AS n_lines, count(b.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS text
  FROM l LEFT JOIN b ON l.host = b.host AND trim(l.line, ' ') = b.line GROUP BY r)
SELECT d.doc_id, d.lang, d.source, d.n_chars, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, k.text FROM d LEFT JOIN k ON d.r = k.r
"""
