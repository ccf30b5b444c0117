"""Line dedup by how many pages of a site carry a line.

Lines are compared without surrounding blanks. A line that stands on more than ``ratio`` of a host's pages is
boilerplate there and is dropped from all of them, if at least ``least`` of them carry it: the support of a line decides,
whatever the size of its host. Each row is one page, repeated rows included.

Only counts are shuffled by line (a hash of 64 bits stands for it, and two lines are confused only on one host).
What exceeds the ratio is short: a host has at most (mean lines of its pages) / ratio such lines. That list
meets the pages by host and a salt, so a hot host is spread over ``SALTS`` keys.

Results for odd input: null texts stay null and empty ones empty; blank lines are never counted nor dropped; rows
without a host are returned as they are; extra columns are kept by ``drop_lines`` under their names; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.frames import col, unused
from wayline.session import settle

RATIO = 0.1
LEAST = 3
SALTS = 64
BLANKS = " \t\r\f\x0b"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """One hash for each line; null for blank lines."""
    return F.transform(lines_of(text), lambda x: F.when(F.trim(x, F.lit(BLANKS)) != "", F.xxhash64(F.trim(x, F.lit(BLANKS)))))


def boilerplate(docs: DataFrame, *, host: str, text: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, lines): hashes of the lines that exceed the ratio on their host."""
    rows = docs.select(col(host).alias("host"), col(text).alias("text")).where("host is not null")
    pages = rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    seen = F.filter(F.array_distinct(_hashes(F.col("text"))), lambda x: x.isNotNull())
    counts = rows.select("host", F.explode(seen).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= least).join(pages, "host").where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_lines(
    docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` without boilerplate lines, in its own columns.

    ``counts`` names two further columns: how many lines a text had, and how many were dropped.
    """
    found = settle(boilerplate(docs, host=host, text=text, ratio=ratio, least=least), "boilerplate")
    at, bad, salts, own, left_over = unused(docs, "_host", "_bad", "_salt", "_own_salt", "_kept")
    salted = found.select(F.col("host").alias(at), F.col("lines").alias(bad), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salts))
    salt = F.pmod(F.xxhash64(col(host), col(text)) + F.monotonically_increasing_id() % 1_000_003, F.lit(SALTS)).cast("int")
    met = docs.withColumn(own, salt).join(salted, (col(host) == F.col(at)) & (F.col(own) == F.col(salts)), "left")
    pairs = F.arrays_zip(lines_of(col(text)).alias("line"), _hashes(col(text)).alias("hash"))
    kept = F.filter(pairs, lambda p: p["hash"].isNull() | ~F.array_contains(F.col(bad), p["hash"]))
    met = met.withColumn(left_over, F.when(F.col(bad).isNotNull(), F.transform(kept, lambda p: p["line"])))
    clean = F.when(F.col(left_over).isNull(), col(text)).otherwise(F.array_join(left_over, "\n"))
    out = [clean.alias(c) if c == text else col(c) for c in docs.columns]
    if counts:
        total = F.when(col(text).isNull(), 0).otherwise(F.size(lines_of(col(text))))
        left = F.when(F.col(left_over).isNull(), total).otherwise(F.size(left_over))
        out += [total.cast("long").alias(counts[0]), (total - left).cast("long").alias(counts[1])]
    return met.select(*out)


#: Parts of a page that show no text, and tags that end a line.
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>)"
BLOCK = r"(?i)</?(p|br|li|ul|ol|nav|div|article|section|h[1-6]|footer|header|title|head|body|html|table|tr)\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def page_text(html: Column) -> Column:
    """Visible text of a page, one block a line, without blank lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "[\r\n\t]", " "), HIDDEN, "\n"), BLOCK, "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), F.lit(""))


def line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    texts = pages.select("page_id", page_host(F.col("url")).alias("host"), page_text(F.col("html")).alias("text"))
    return drop_lines(settle(texts, "page-texts"), host="host", counts=("n_lines", "n_dropped"))


def documents_sql(source: str, ratio: float = RATIO, least: int = LEAST) -> str:
    """SELECT of (page_id, host, text, n_lines, n_dropped) from a relation with page_id, host and text."""
    bare = "trim(l, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
    return f"""
        SELECT d.page_id, d.host,
               CASE WHEN b.bad IS NULL THEN d.text
                    ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda l: NOT list_contains(b.bad, {bare})), chr(10)) END AS text,
               CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
               CASE WHEN d.text IS NULL OR b.bad IS NULL THEN 0
                    ELSE len(list_filter(string_split(d.text, chr(10)), lambda l: list_contains(b.bad, {bare}))) END AS n_dropped
        FROM {source} d
        LEFT JOIN (
            SELECT c.host, list(c.line) AS bad
            FROM (SELECT host, line, count(*) AS n
                  FROM (SELECT host, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda l: {bare}))) AS line FROM {source})
                  WHERE line <> '' GROUP BY host, line) c
            JOIN (SELECT host, count(*) AS pages FROM {source} GROUP BY host) p ON c.host = p.host
            WHERE c.n >= {least} AND c.n > {ratio}::DOUBLE * p.pages
            GROUP BY c.host
        ) b ON d.host = b.host"""


def _page_sql() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '[\\r\\n\\t]', ' ', 'g'), '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, sign in ENTITIES:
        text = f"replace({text}, '{name}', '{sign}')"
    return f"""
        SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '') AS host,
               array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text
        FROM pages"""


QUERIES = {"op2_line_frequency": line_frequency}
ORACLES = {
    "op2_line_frequency": f"WITH t AS ({_page_sql()}) SELECT page_id, host, text, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped FROM ({documents_sql('t')})"
}
