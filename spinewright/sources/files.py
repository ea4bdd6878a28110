"""File sources and sinks: release listing, box scans, ragged geocoder replies, request batches, typed JSON, pages of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOCODE_FIELDS = ("id", "input", "match", "kind", "matched", "lng_lat", "line_id", "side")


def releases(spark: SparkSession, root: str, pattern: str = r"release/([^/]+)/") -> DataFrame:
    """Distinct release names below ``root``, newest first; only paths are listed, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(F.regexp_extract("path", pattern, 1).alias("release"))
    return found.where("release <> ''").distinct().orderBy(F.desc("release"))


def box_scan(spark: SparkSession, path: str, south: float, west: float, north: float, east: float, columns: list[str], box: str = "bbox") -> DataFrame:
    """Columns of a nested Parquet data set within a box; the predicate on the box's fields reaches the scan."""
    inside = F.col(f"{box}.xmin").between(west, east) & F.col(f"{box}.ymin").between(south, north)
    return spark.read.parquet(path).where(inside).select(*columns)


def geocoded(lines: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Geocoder reply lines (column ``value``), quoted CSV of three or eight fields in any order, with ``outcome``:
    match, no_match, tie, out_of_bounds or malformed."""
    row = F.from_csv("value", F.lit(", ".join(f"{f} string" for f in GEOCODE_FIELDS)))
    r = lines.where(F.trim("value") != "").select("value", row.alias("r")).select("value", "r.*")
    place = F.split("lng_lat", ",")
    r = r.withColumns({"lng": F.try_element_at(place, F.lit(1)).try_cast("double"), "lat": F.try_element_at(place, F.lit(2)).try_cast("double")})
    inside = F.col("lat").between(south, north) & F.col("lng").between(west, east)
    outcome = (
        F.when(F.col("match") == "No_Match", "no_match").when(F.col("match") == "Tie", "tie")
        .when((F.col("match") == "Match") & F.col("kind").isin("Exact", "Non_Exact") & F.col("lat").isNotNull(), F.when(inside, "match").otherwise("out_of_bounds")).otherwise("malformed")
    )
    return r.select("id", outcome.alias("outcome"), "kind", F.when(outcome == "match", F.col("lat")).alias("lat"), F.when(outcome == "match", F.col("lng")).alias("lng"))


def geocode_batch(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Request lines: control characters scrubbed, every field quoted."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\x00-\x1F\x7F]+", " ")
    quoted: list[Column] = [F.concat(F.lit('"'), F.replace(clean(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return rows.select(F.concat_ws(",", *quoted).alias("value"))


def typed_json(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines (column ``value``) as rows of ``schema``, and the lines that don't parse; unlisted fields are dropped."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.where("r is not null and r._bad is null").select(*[F.col(f"r.{f.name}") for f in schema.fields])
    return good, parsed.where("r is null or r._bad is not null").select("value")


def seed(spark: SparkSession, path: str, array: str) -> DataFrame:
    """A seed file with one object that holds an array of rows."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode(array).alias("r")).select("r.*")
