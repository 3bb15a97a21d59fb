"""Line removal by site-relative frequency.

Pages are grouped by host; a line that stands on more than a given share of its host's pages is boilerplate there
and leaves all of that host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, kept, table, with_columns

#: Lines on one page alone repeat nothing; else a host of a few pages would lose all of its lines.
RATIO, MIN_PAGES = 0.1, 2
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: What goes without a trace: scripts, styles, comments, and tags that stand within a line.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|</?(?:a|abbr|b|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u)(?:\s[^>]*)?>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&amp;": "&"}
TAG = r"<[^>]+>"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def visible_lines(html: Column) -> Column:
    """HTML as lines: scripts, styles, comments and tags within a line go, every other tag ends a line, and the commonest entities are read."""
    out = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), TAG, "\n")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def drop_boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of pages and then host, n_lines, n_dropped (int) and text; these replace columns so named.

    Lines are text split at U+000A, trimmed of spaces, blank ones left out. A line is dropped if it is on at
    least min_pages pages of the host and on more than ratio of them; a page counts once for a line however often
    it holds it. Every row counts as a page, repeated rows too. Pages of a null host keep all their lines. A null
    text has no lines and stays null; a text that loses every line becomes empty.

    Only (host, digest of a line) is counted, with partial sums before the shuffle, so a host or line that a third
    of the pages hold is a third of the rows of one partial sum each. The lines to drop come to a host as one array
    of digests; there can be at most (mean lines of its pages) / ratio of them, however many pages it has. Pages
    meet that array in a join on host which Spark may split or broadcast by the measured size.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    base = with_columns(pages, {"host": host, "_pl_lines": lines})
    marked = base.select("host", F.transform(F.array_distinct(F.col("_pl_lines")), lambda x: F.unhex(F.md5(x))).alias("d")).where("host is not null")
    per_host = marked.groupBy("host").agg(F.count("*").alias("n_pages"))
    per_line = marked.select("host", F.explode("d").alias("d")).groupBy("host", "d").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    drop = per_line.join(per_host, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("n_pages")).groupBy("host").agg(F.collect_list("d").alias("_pl_drop"))
    both = base.join(kept(drop, "line-dedup"), "host", "left")
    good = F.when(F.col("_pl_drop").isNull(), F.col("_pl_lines")).otherwise(F.filter("_pl_lines", lambda x: ~F.array_contains(F.col("_pl_drop"), F.unhex(F.md5(x)))))
    done = both.withColumn("_pl_good", good)
    n = lambda x: F.when(F.col("_pl_lines").isNull(), 0).otherwise(x).cast("int")
    out = {"host": F.col("host"), "n_lines": n(F.size("_pl_lines")), "n_dropped": n(F.size("_pl_lines") - F.size("_pl_good")), "text": F.array_join("_pl_good", "\n")}
    rest = [c for c in pages.columns if c.lower() not in out]
    return done.select(*map(col, rest), *[v.alias(k) for k, v in out.items()])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("text"))
    pages = kept(pages, "page-lines")  # the HTML is read once
    return drop_boilerplate(pages, F.col("host"), F.col("text")).select("page_id", "host", "n_lines", "n_dropped", "text")


def _read(x: str) -> str:
    for entity, sign in ENTITIES.items():
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


SQL = f"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         list_filter(list_transform(string_split({_read(f"regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{TAG}', chr(10), 'g')")}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
  FROM pages
), n AS (SELECT host, count(*) AS n_pages FROM p WHERE host IS NOT NULL GROUP BY host),
l AS (SELECT host, unnest(list_distinct(ls)) AS x FROM p WHERE host IS NOT NULL),
d AS (
  SELECT l.host, list(DISTINCT x) AS xs FROM (SELECT host, x, count(*) AS c FROM l GROUP BY host, x) l JOIN n ON n.host = l.host
  WHERE c >= {MIN_PAGES} AND c > {RATIO}::DOUBLE * n_pages GROUP BY l.host
), k AS (
  SELECT page_id, p.host, ls, CASE WHEN xs IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(xs, x)) END AS g
  FROM p LEFT JOIN d ON d.host = p.host
)
SELECT page_id, host, coalesce(len(ls), 0)::INT AS n_lines, coalesce(len(ls) - len(g), 0)::INT AS n_dropped,
       CASE WHEN g IS NULL THEN NULL ELSE coalesce(array_to_string(g, chr(10)), '') END AS text
FROM k
"""
