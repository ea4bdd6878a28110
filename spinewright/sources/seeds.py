"""Seed files as seven reference tables: natural keys, references between files resolved to ids, tallies.

The files are ``counties.json``, ``clusters.json``, ``cities.json``, ``outlet-counts.json``, ``geo-presets.json`` and
``overture-categories.json`` in one folder, each one object. A row's ``id`` follows from its table and natural key, so a
file loaded again updates the rows it made. A reference that no row answers is an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import materialize

# The tables in the order of their references, with their natural keys.
KEYS = {
    "counties": ("fips",), "industry_clusters": ("key",), "industry_terms": ("cluster_id", "kind", "value"), "cities": ("county_id", "name"),
    "outlet_counts": ("scope", "county_id", "cluster_id"), "geo_presets": ("key",), "overture_category_map": ("basic_category",),
}
_FILES = {
    "counties": "counties array<struct<fips string, countyFips string, comptrollerCode string, name string, isRgv boolean, outletCount long>>",
    "clusters": "clusters array<struct<key string, displayName string, sortOrder int, naicsRanges array<struct<lo long, hi long>>, placesTypes array<string>>>",
    "cities": "cities array<struct<countyFips string, name string, nameVariants array<string>, outletCount long>>",
    "outlet-counts": "measuredAt string, source string, outletCounts array<struct<scope string, countyFips string, clusterKey string, outlets long>>",
    "geo-presets": "geoPresets array<struct<key string, displayName string, kind string, cities array<struct<countyFips string, name string>>, counties array<string>>>",
    "overture-categories": "categories array<struct<basicCategory string, clusterKey string, rows long>>",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_FILES[name]).option("multiLine", "true").option("mode", "FAILFAST").json(f"{folder}/{name}.json")


def _id(table: str, *key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(table), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])).alias("id")


def _resolved(rows: DataFrame, table: DataFrame, ref: Column, to: Column, name: str, what: Column) -> DataFrame:
    """``rows`` with the id of the row of ``table`` whose ``to`` is ``ref`` as ``name``; a null reference stays null."""
    found = table.select(F.col("id").alias(name), to.alias("_to"))
    out = rows.withColumn("_ref", ref).join(F.broadcast(found), F.col("_ref") == F.col("_to"), "left")  # a seed table is some hundred rows
    lost = out.where(F.col("_ref").isNotNull() & F.col(name).isNull()).select(F.concat(what, F.lit(" "), F.col("_ref")).alias("w")).limit(5).collect()
    if lost:
        raise ValueError("; ".join(sorted(f"seed: {r['w']} resolved to no row" for r in lost)))
    return out.drop("_ref", "_to")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven tables that the files in ``folder`` make."""
    c = F.col
    rows = lambda name, array, *keep: _read(spark, folder, name).select(*keep, F.explode(array).alias("r"))
    county = rows("counties", "counties").select("r.*")
    counties = materialize(county.select(_id("counties", "fips"), "fips", c("countyFips").alias("county_fips"), c("comptrollerCode").alias("comptroller_code"), "name", c("isRgv").alias("is_rgv"), c("outletCount").alias("outlet_count")))
    cluster = materialize(rows("clusters", "clusters").select("r.*", _id("industry_clusters", "r.key")))
    clusters = cluster.select("id", "key", c("displayName").alias("display_name"), c("sortOrder").alias("sort_order"))
    none = F.lit(None).cast("long")
    # ranges hold their lower bound and end before the upper one; place types have no bounds
    ranges = cluster.select(c("id").alias("cluster_id"), F.explode("naicsRanges").alias("x")).select("cluster_id", F.lit("naics_range").alias("kind"), F.concat_ws("-", "x.lo", "x.hi").alias("value"), c("x.lo").alias("naics_lo"), c("x.hi").alias("naics_hi"))
    kinds = cluster.select(c("id").alias("cluster_id"), F.explode("placesTypes").alias("value")).select("cluster_id", F.lit("places_type").alias("kind"), "value", none.alias("naics_lo"), none.alias("naics_hi"))
    terms = ranges.unionByName(kinds)
    terms = terms.select(_id("industry_terms", "cluster_id", "kind", "value"), *terms.columns)
    city = _resolved(rows("cities", "cities").select("r.*"), counties, c("countyFips"), c("fips"), "county_id", F.concat(F.lit("city "), "name", F.lit(" county fips")))
    cities = materialize(city.select(_id("cities", "county_id", "name"), "county_id", "name", c("nameVariants").alias("name_variants"), c("outletCount").alias("outlet_count"), F.lit(True).alias("is_rgv_seed"), c("countyFips").alias("_fips")))
    count = rows("outlet-counts", "outletCounts", "measuredAt", "source").select("measuredAt", "source", "r.*")
    count = _resolved(count, counties, c("countyFips"), c("fips"), "county_id", F.lit("outlet_counts county fips"))
    count = _resolved(count, clusters, c("clusterKey"), c("key"), "cluster_id", F.lit("outlet_counts cluster key"))
    measured = F.to_timestamp(F.concat("measuredAt", F.lit("T00:00:00Z")))
    outlets = count.select(_id("outlet_counts", "scope", "county_id", "cluster_id"), "scope", "county_id", "cluster_id", "outlets", measured.alias("measured_at"), "source")
    category = _resolved(rows("overture-categories", "categories").select("r.*"), clusters, c("clusterKey"), c("key"), "_cluster", F.concat(F.lit("overture_category_map "), "basicCategory", F.lit(" cluster key")))
    numbered = category.groupBy().agg(F.sort_array(F.collect_list(F.struct((-c("rows")).alias("n"), c("basicCategory").alias("basic_category"), c("clusterKey").alias("cluster_key")))).alias("all"))  # one small file
    categories = numbered.select(F.posexplode("all").alias("at", "x")).select("x.basic_category", "x.cluster_key", (c("at") + 1).alias("sort_order"))
    categories = categories.select(_id("overture_category_map", "basic_category"), *categories.columns)
    return {
        "counties": counties, "industry_clusters": clusters, "industry_terms": terms, "cities": cities.drop("_fips"), "outlet_counts": outlets,
        "geo_presets": _presets(rows("geo-presets", "geoPresets").select("r.*"), counties, cities), "overture_category_map": categories,
    }


def _presets(preset: DataFrame, counties: DataFrame, cities: DataFrame) -> DataFrame:
    """Presets whose references to cities and counties are ids in the order of the file."""
    c = F.col
    odd = [f"{r['key']} has unseedable kind {r['kind']}" for r in preset.where(~c("kind").isin("cities", "counties")).orderBy("key").limit(5).collect()]
    if odd:
        raise ValueError("; ".join(f"seed: geo_preset {x}" for x in odd))
    to_city = preset.where("kind = 'cities'").select("key", F.posexplode("cities").alias("at", "x"))
    to_city = _resolved(to_city, cities, F.concat_ws("|", "x.countyFips", "x.name"), F.concat_ws("|", "_fips", "name"), "of", F.concat(F.lit("geo_preset "), "key", F.lit(" city ref")))
    to_county = preset.where("kind = 'counties'").select("key", F.posexplode("counties").alias("at", "x"))
    to_county = _resolved(to_county, counties, c("x"), c("fips"), "of", F.concat(F.lit("geo_preset "), "key", F.lit(" county fips")))
    ids = to_city.select("key", "at", "of").unionByName(to_county.select("key", "at", "of")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "of"))), lambda s: s["of"]).alias("ids"))
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    payload = F.when(c("kind") == "cities", F.to_json(F.struct(listed.alias("cityIds")))).otherwise(F.to_json(F.struct(listed.alias("countyIds"))))
    return preset.join(ids, "key", "left").select(_id("geo_presets", "key"), "key", c("displayName").alias("display_name"), "kind", payload.alias("payload"))


def loaded(stored: dict[str, DataFrame] | None, new: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a load: seeded rows in place of the stored ones of their natural key, the other stored rows as they were;
    and ``table, inserted, updated``. A key that a file names twice is an error."""
    out, tally = {}, None
    for name, keys in KEYS.items():
        rows = materialize(new[name])
        twice = rows.groupBy("id").agg(F.count("*").alias("n"), F.first(F.to_json(F.struct(*keys))).alias("k")).where("n > 1").limit(5).collect()
        if twice:
            raise ValueError(f"seed: {name} names {', '.join(sorted(r['k'] for r in twice))} twice")
        old = None if stored is None else stored[name]
        seen = rows.withColumn("known", F.lit(False)) if old is None else rows.join(old.select("id", F.lit(True).alias("known")), "id", "left")
        one = seen.agg(F.count_if(~F.coalesce("known", F.lit(False))).alias("inserted"), F.count_if(F.coalesce("known", F.lit(False))).alias("updated")).select(F.lit(name).alias("table"), "inserted", "updated")
        tally = one if tally is None else tally.unionByName(one)
        out[name] = rows if old is None else rows.unionByName(old.join(rows.select("id"), "id", "left_anti"))
    return out, tally
