"""GPX and KML documents as ordered text pieces.

A document is a head piece, one piece per fix and a foot piece. Pieces of one trip
stay spread over tasks, however long the trip; reading them in ``PLACE`` order gives
the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import number_text, xml_escape
from ..operators.movement import positioned

# Document namespaces and the style of the track line.
GPX_NS = "http://www.topografix.com/GPX/1/1"
KML_NS = "http://www.opengis.net/kml/2.2"
LINE_COLOR, LINE_WIDTH = "ff0000ff", "4"
CREATOR = "wayline"

HEAD, BODY, FOOT = 0, 1, 2
PLACE = ["part", "ts_us", "recording_id", "pos"]


def _edge(trips: DataFrame, keys: Sequence[str], part: int, text: Column) -> DataFrame:
    return trips.select(
        *keys, F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("ts_us"), F.lit("").alias("recording_id"),
        F.lit(0).cast("bigint").alias("pos"), text.alias("text"),
    )


def gpx_pieces(fixes: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GPX 1.1 pieces of every trip in ``trips`` (keys and ``name``, may be NULL)."""
    ok = fixes.filter(positioned())
    extra = F.concat(
        F.lit("        <extensions>\n"),
        F.coalesce(F.concat(F.lit("          <speed>"), number_text(F.col("speed_kmh") / 3.6), F.lit("</speed>\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("          <course>"), number_text("course"), F.lit("</course>\n")), F.lit("")),
        F.lit("        </extensions>\n"),
    )
    point = F.concat(
        F.lit('      <trkpt lat="'), number_text("lat"), F.lit('" lon="'), number_text("lon"), F.lit('">\n        <time>'),
        clock.iso_seconds("ts"), F.lit("Z</time>\n"),
        F.when(F.col("speed_kmh").isNotNull() | F.col("course").isNotNull(), extra).otherwise(F.lit("")),
        F.lit("      </trkpt>"),
    )
    body = ok.select(
        *keys, F.lit(BODY).alias("part"), "ts_us", "recording_id", F.col("pos").cast("bigint").alias("pos"), point.alias("text")
    )
    counted = trips.join(ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys), "left")
    some = F.coalesce(F.col("_n"), F.lit(0)) > 0
    name = F.when(
        F.coalesce("name", F.lit("")) != "", F.concat(F.lit("    <name>"), xml_escape("name"), F.lit("</name>\n"))
    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit(f"<?xml version='1.0' encoding='UTF-8'?>\n<gpx xmlns=\"{GPX_NS}\" version=\"1.1\" creator=\"{CREATOR}\">\n  <trk>\n"),
        name, F.when(some, F.lit("    <trkseg>")).otherwise(F.lit("    <trkseg />")),
    )
    foot = F.when(some, F.lit("    </trkseg>\n  </trk>\n</gpx>")).otherwise(F.lit("  </trk>\n</gpx>"))
    return _edge(counted, keys, HEAD, head).unionByName(body).unionByName(_edge(counted, keys, FOOT, foot))


def kml_pieces(fixes: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KML pieces of every trip with at least one point: start mark and track line."""
    ok = fixes.filter(positioned())
    at = F.concat(number_text("lon"), F.lit(","), number_text("lat"))
    body = ok.select(
        *keys, F.lit(BODY).alias("part"), "ts_us", "recording_id", F.col("pos").cast("bigint").alias("pos"), at.alias("text")
    )
    first = ok.groupBy(*keys).agg(
        F.min_by(F.struct("lat", "lon"), F.struct("ts_us", "recording_id", "pos")).alias("_p")
    )
    known = trips.join(first, list(keys))
    name = xml_escape("name")
    start = F.concat(number_text("_p.lon"), F.lit(","), number_text("_p.lat"))
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="{KML_NS}">\n  <Document>\n    <name>'), name,
        F.lit(
            f'</name>\n    <Style id="track">\n      <LineStyle>\n        <color>{LINE_COLOR}</color>\n'
            f"        <width>{LINE_WIDTH}</width>\n      </LineStyle>\n    </Style>\n    <Placemark>\n"
            "      <name>Start</name>\n      <Point>\n        <coordinates>"
        ),
        start,
        F.lit("</coordinates>\n      </Point>\n    </Placemark>\n    <Placemark>\n      <name>"), name,
        F.lit(
            "</name>\n      <styleUrl>#track</styleUrl>\n      <LineString>\n        <tessellate>1</tessellate>\n"
            "        <coordinates>"
        ),
    )
    foot = F.lit("</coordinates>\n      </LineString>\n    </Placemark>\n  </Document>\n</kml>")
    return _edge(known, keys, HEAD, head).unionByName(body).unionByName(_edge(known, keys, FOOT, foot))


def write_pieces(pieces: DataFrame, path: str, key: str, place: Sequence[str] = tuple(PLACE)) -> None:
    """One folder per ``key`` value; its part files in name order make the document.

    Range partitioning splits a long document over many tasks.
    """
    ordered = pieces.repartitionByRange(key, *place).sortWithinPartitions(key, *place)
    ordered.select(key, "text").write.partitionBy(key).text(path)
