"""Seed files into tables: references, replays and refusals."""

import json

import pytest

from spinewright.sources import seeds

FILES = {
    "counties": {"counties": [{"fips": "48215", "countyFips": "215", "comptrollerCode": "108", "name": "Hidalgo", "isRgv": True, "outletCount": 7}, {"fips": "48061", "countyFips": "061", "comptrollerCode": "31", "name": "Cameron", "isRgv": True, "outletCount": 5}]},
    "clusters": {"clusters": [{"key": "food", "displayName": "Food", "sortOrder": 1, "naicsRanges": [{"lo": 722000, "hi": 723000}], "placesTypes": ["restaurant", "cafe"]}]},
    "cities": {"cities": [{"countyFips": "48215", "name": "McAllen", "nameVariants": ["Mc Allen"], "outletCount": 3}]},
    "outlet-counts": {"measuredAt": "2026-09-22", "source": "permits", "outletCounts": [{"scope": "county", "countyFips": "48215", "clusterKey": "food", "outlets": 11}, {"scope": "state", "countyFips": None, "clusterKey": "food", "outlets": 99}]},
    "geo-presets": {"geoPresets": [{"key": "two", "displayName": "Two", "kind": "counties", "cities": None, "counties": ["48061", "48215"]}, {"key": "city", "displayName": "City", "kind": "cities", "cities": [{"countyFips": "48215", "name": "McAllen"}], "counties": None}]},
    "overture-categories": {"categories": [{"basicCategory": "bar", "clusterKey": "food", "rows": 2}, {"basicCategory": "diner", "clusterKey": "food", "rows": 9}]},
}


def _folder(tmp_path, **changed):
    for name, content in (FILES | {k.replace("_", "-"): v for k, v in changed.items()}).items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    return str(tmp_path)


def test_seven_tables_and_a_replay(spark, tmp_path):
    made, tally = seeds.loaded(None, seeds.tables(spark, _folder(tmp_path)))
    assert {r["table"]: (r["inserted"], r["updated"]) for r in tally.collect()} == {"counties": (2, 0), "industry_clusters": (1, 0), "industry_terms": (3, 0), "cities": (1, 0), "outlet_counts": (2, 0), "geo_presets": (2, 0), "overture_category_map": (2, 0)}
    ids = {r["name"]: r["id"] for t in ("counties", "cities") for r in made[t].collect()}
    assert {r["key"]: json.loads(r["payload"]) for r in made["geo_presets"].collect()} == {"two": {"countyIds": [ids["Cameron"], ids["Hidalgo"]]}, "city": {"cityIds": [ids["McAllen"]]}}
    assert {(r["kind"], r["value"], r["naics_lo"]) for r in made["industry_terms"].collect()} == {("naics_range", "722000-723000", 722000), ("places_type", "restaurant", None), ("places_type", "cafe", None)}
    assert [r["basic_category"] for r in made["overture_category_map"].orderBy("sort_order").collect()] == ["diner", "bar"]
    assert str(made["outlet_counts"].first()["measured_at"]) == "2026-09-22 00:00:00"
    again, tally = seeds.loaded(made, seeds.tables(spark, str(tmp_path)))
    assert all(r["inserted"] == 0 for r in tally.collect()) and all(sorted(map(str, again[t].collect())) == sorted(map(str, made[t].collect())) for t in made)


@pytest.mark.parametrize(("file", "content", "message"), [
    ("cities", {"cities": [{"countyFips": "99999", "name": "X", "nameVariants": [], "outletCount": 1}]}, "city X county fips 99999 resolved to no row"),
    ("overture_categories", {"categories": [{"basicCategory": "bar", "clusterKey": "none", "rows": 2}]}, "bar cluster key none resolved to no row"),
    ("geo_presets", {"geoPresets": [{"key": "p", "displayName": "P", "kind": "cities", "cities": [{"countyFips": "48215", "name": "Nowhere"}], "counties": None}]}, "geo_preset p city ref 48215|Nowhere"),
    ("geo_presets", {"geoPresets": [{"key": "p", "displayName": "P", "kind": "radius", "cities": None, "counties": None}]}, "p has unseedable kind radius"),
])
def test_lost_references_are_named(spark, tmp_path, file, content, message):
    with pytest.raises(ValueError, match=message.replace("|", r"\|")):
        seeds.tables(spark, _folder(tmp_path, **{file: content}))


def test_a_key_named_twice_is_refused(spark, tmp_path):
    twice = {"counties": FILES["counties"]["counties"] + FILES["counties"]["counties"][:1]}
    with pytest.raises(ValueError, match="counties names .*48215.* twice"):
        seeds.loaded(None, seeds.tables(spark, _folder(tmp_path, counties=twice)))
