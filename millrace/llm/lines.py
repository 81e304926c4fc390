"""Line dedup by site-relative frequency.

A line's ratio is the number of a host's pages that hold it, divided by the host's pages.
Lines above ``ratio`` that stand on at least ``least_pages`` pages are the host's boilerplate
and are dropped. Lines are split at ``\\n`` and compared without white space around them;
blank lines are neither counted nor dropped. A page all of whose lines would go is a copy of
other pages and not boilerplate; it is left as it is.

Counting keeps each page's distinct lines and adds up (host, line digest) where the rows are
read, so a hot host or line gives at most one row per read task to the shuffle. A host has at
most (mean lines a page) / ratio boilerplate lines. They are joined to the pages as one array
per host: by broadcast if ``broadcast_lines`` lines at most were found (a digest of 16 bytes
each and the host), else by a join on host and a salt, for which each host's array is
repeated ``salts`` times, so that a hot host's pages spread over tasks.

Defined cases: null text stays null and counts as a page; null host is a host of its own;
repeated rows are pages of their own; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, table

RATIO = 0.08
LEAST_PAGES = 8
_SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits that stand for the line."""
    return F.unhex(F.md5(F.btrim(line, F.lit(_SPACE))))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE)) == ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line): the digests of each host's boilerplate lines."""
    own = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _key))
    on = own.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    total = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    o, t = on.alias("o"), total.alias("t")
    return o.join(t, F.col("o.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > ratio * F.col("pages")).select("o.host", "line")


def _kept(text: Column, drop: Column) -> Column:
    rest = F.filter(_lines(text), lambda x: _blank(x) | ~F.array_contains(drop, _key(x)))
    # a page of boilerplate alone stays whole
    return F.when(F.exists(rest, lambda x: ~_blank(x)), F.array_join(rest, "\n")).otherwise(text)


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = 50_000, salts: int = 64) -> DataFrame:
    """The pages without their hosts' boilerplate lines; all columns and rows stay."""
    scratch = Scratch(pages.sparkSession)
    found = scratch.put(boilerplate(pages, host, text, ratio, least_pages))
    drop, key, salt, mine = (free_name(pages, x) for x in ("_drop", "_host", "_salt", "_mine"))
    by_host = found.groupBy("host").agg(F.collect_list("line").alias(drop)).withColumnRenamed("host", key)
    same = pages[host].eqNullSafe(F.col(key))
    if found.count() <= broadcast_lines:
        joined = pages.join(F.broadcast(by_host), same, "left")
    else:
        spread = by_host.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt))
        dealt = pages.withColumn(mine, F.pmod(F.xxhash64(F.coalesce(pages[text], F.lit(""))), F.lit(salts)).cast("int"))
        joined = dealt.join(spread, same & (F.col(mine) == F.col(salt)), "left")
    new = F.when(F.col(drop).isNull(), F.col(f"`{text}`")).otherwise(_kept(F.col(f"`{text}`"), F.col(drop)))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as the host: what is left of each text, as length and digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_before"))
    done = drop_boilerplate(docs)
    return done.select("doc_id", "n_before", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_after"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH parts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, E' \t\n\x0b\x0c\r')), lambda x: x <> ''))) AS line FROM parts
), counted AS (
  SELECT source, line, count(*) AS n FROM lines GROUP BY ALL
), boiler AS (
  SELECT c.source, list(line) AS gone FROM counted c
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) s ON c.source IS NOT DISTINCT FROM s.source
  WHERE n >= 8 AND n > 0.08 * pages GROUP BY c.source
), kept AS (
  SELECT p.*, list_filter(p.lines, lambda x: trim(x, E' \t\n\x0b\x0c\r') = '' OR NOT list_contains(coalesce(gone, []), trim(x, E' \t\n\x0b\x0c\r'))) AS rest
  FROM parts p LEFT JOIN boiler b ON p.source IS NOT DISTINCT FROM b.source
), done AS (
  SELECT doc_id, text, CASE WHEN len(list_filter(rest, lambda x: trim(x, E' \t\n\x0b\x0c\r') <> '')) = 0 THEN text ELSE array_to_string(rest, chr(10)) END AS new_text FROM kept
)
SELECT doc_id, length(text)::BIGINT AS n_before, length(new_text)::BIGINT AS n_after, sha256(new_text) AS text_sha256 FROM done
"""
