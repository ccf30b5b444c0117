"""Readers for subtitle, scene and plain text files, one file per input row.

Everything happens inside the row with array expressions, so no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, srt_seconds

# Line ends, subtitle timing line, timed bullet marker, sign-read stamp.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
OTHER_LINE_END = r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
LINE_ENDS = tuple("\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
TIMING = (
    r"(\d+):(\d{2}):(\d{2}),(\d{3})[^\S\r\n]*-->[^\S\r\n]*(\d+):(\d{2}):(\d{2}),(\d{3})"
)
BULLET = r"(?i)-\s*\[\s*t\s*=\s*([^\]]*)\]"
SIGN_STAMP = r"^\[t=(\d+(?:\.\d+)?)s\]"
SIGN_HEADING = "zoomed sign reads"
NOT_LEGIBLE = "not legible"
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lines_of(text: Column) -> Column:
    """Array of lines; a final line end adds no empty line."""
    size = F.length(text)
    cut = F.when(F.right(text, F.lit(2)) == "\r\n", 2).when(F.right(text, F.lit(1)).isin(*LINE_ENDS), 1).otherwise(0)
    body = F.left(text, size - cut)
    return F.when(text != "", F.split(body, LINE_END)).otherwise(F.array().cast("array<string>"))


def _rest(parts: Column) -> Column:
    """All parts but the first. ``parts`` stands here once, since a generator evaluates it as often as it is named."""
    return F.slice(parts, F.lit(2), F.lit(1 << 30))


def text_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with its 1-based ``line_no``."""
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, F.posexplode(lines_of(F.col(text))).alias("_p", "line")).select(
        *kept, (F.col("_p") + 1).cast("bigint").alias("line_no"), "line"
    )


def srt_cues(files: DataFrame, text: str = "text") -> DataFrame:
    """Subtitle cues in file order: ``pos``, ``start_s``, ``end_s``, ``text``.

    The timing line may stand anywhere in its block; the text is what follows it.
    """
    kept = [c for c in files.columns if c != text]
    blocks = F.filter(
        F.split(_trim(F.col(text)), r"\r?\n\r?\n+"), lambda b: b.rlike(TIMING)
    )
    rows = files.select(*kept, F.posexplode(blocks).alias("pos", "_block"))

    def part(i: int) -> Column:
        return F.regexp_extract("_block", TIMING, i)

    after = F.regexp_extract("_block", TIMING + r"[^\r\n]*(?:\r\n|\n|\r)([\s\S]*)$", 9)
    return rows.select(
        *kept, F.col("pos").cast("bigint").alias("pos"),
        srt_seconds(part(1), part(2), part(3), part(4)).alias("start_s"),
        srt_seconds(part(5), part(6), part(7), part(8)).alias("end_s"),
        _trim(F.regexp_replace(after, r"\r\n?", "\n")).alias("text"),
    )


def scene_events(files: DataFrame, text: str = "text") -> DataFrame:
    """Timed bullets ``- [t=1.5s] words``: ``pos``, ``t_s``, ``text``.

    Markers may sit anywhere, also all on one line, with blanks inside the stamp. The
    text runs to the next marker. Bullets without a number or text are left out.
    """
    kept = [c for c in files.columns if c != text]
    stamps = F.regexp_extract_all(F.col(text), F.lit(BULLET), 1)
    words = F.split(F.col(text), BULLET)
    pairs = F.zip_with(
        stamps, _rest(words),
        lambda s, w: F.struct(
            F.regexp_replace(F.regexp_replace(s, r"\s+", ""), "(?i)s$", "").try_cast("double").alias("t_s"),
            squeeze(w).alias("text"),
        ),
    )
    good = F.filter(pairs, lambda p: p["t_s"].isNotNull() & (p["text"] != ""))
    return files.select(*kept, F.posexplode(good).alias("pos", "_e")).select(
        *kept, F.col("pos").cast("bigint").alias("pos"), "_e.t_s", "_e.text"
    )


def sign_reads(files: DataFrame, text: str = "text") -> DataFrame:
    """Legible reads of the zoomed-sign section: ``pos``, ``t_s``, ``text``.

    Other lines of the section belong to the bullet above; the section ends at the
    next heading or ``---``. Without a stamp the time is 0.
    """
    kept = [c for c in files.columns if c != text]
    # every step names the one before once, and every pattern starts with a plain line end
    flat = F.when(F.col(text).rlike(OTHER_LINE_END), F.regexp_replace(F.col(text), LINE_END, "\n")).otherwise(F.col(text))
    heading = rf"\n[^\S\n]*#[^\n]*(?i:{SIGN_HEADING})[^\n]*"
    body = F.try_element_at(F.split(F.concat(F.lit("\n"), flat), heading, 2), F.lit(2))
    body = F.regexp_replace(body, heading, "")
    body = F.element_at(F.split(body, r"\n[^\S\n]*(?:#|---)", 2), 1)
    lines = F.filter(F.transform(F.split(body, "\n"), _trim), lambda x: x != "")
    bullets = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), "\n- ")
    # the lines are trimmed, so nothing blank stands before a line end
    reads = F.transform(_rest(bullets), lambda b: _trim(F.replace(b, F.lit("\n"), F.lit(" "))))
    legible = F.filter(
        reads, lambda b: (b != "") & ~F.contains(F.lower(b), F.lit(NOT_LEGIBLE))
    )
    rows = files.select(*kept, F.posexplode(legible).alias("pos", "_r"))
    rows = rows.withColumn("_t", F.when(F.startswith("_r", F.lit("[t=")), F.regexp_extract("_r", SIGN_STAMP, 1)).otherwise(""))
    after = F.substr("_r", F.length("_t") + len("[t=s]") + 1)
    return rows.select(
        *kept, F.col("pos").cast("bigint").alias("pos"),
        F.when(F.col("_t") != "", F.col("_t").try_cast("double")).otherwise(F.lit(0.0)).alias("t_s"),
        F.when(F.col("_t") != "", _trim(after)).otherwise(F.col("_r")).alias("text"),
    )
