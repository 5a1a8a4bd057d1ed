import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from nichegrid.functions.geo import archive_coordinates, upload_coordinates
from nichegrid.sources import archives, files, geojson, occurrences, regions, surfaces
from nichegrid.sources.files import read_presence_file
from nichegrid.standins import point_shapefile

COLUMNS = ["species", "year", "lon", "lat"]


def rows(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def feature(lon, lat, **properties):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": properties}


EXPECTED = [("Aquila", 2021, 11.5, 47.25), ("Lagopus", 2020, 11.4, 47.2)]


@pytest.mark.parametrize("separator", [",", ";", "\t"])
@pytest.mark.parametrize("header", ["lon,lat", "decimalLongitude,decimalLatitude", "X,Y", "Longitude,Latitude"])
def test_csv_headers_and_separators(spark, tmp_path, header, separator):
    text = f"{header},Species,Year\n11.4,47.2,Lagopus,2020\n11.5,47.25,Aquila,2021\n"
    assert rows(read_presence_file(spark, write(tmp_path / "p.csv", text.replace(",", separator)))) == EXPECTED


def test_csv_without_species_or_year(spark, tmp_path):
    path = write(tmp_path / "p.txt", "x,y\n1.5,2.5\n3,4\n")
    assert rows(read_presence_file(spark, path)) == [("unknown", None, 1.5, 2.5), ("unknown", None, 3.0, 4.0)]


def test_csv_bad_values(spark, tmp_path):
    path = write(tmp_path / "p.csv", "x,y,taxon,date\n1,2,,2020-05-01\n1,abc,T,nan\n")
    assert rows(read_presence_file(spark, path)) == [("T", None, 1.0, None), (None, None, 1.0, 2.0)]


def test_csv_without_coordinates(spark, tmp_path):
    with pytest.raises(ValueError, match="coordinate"):
        read_presence_file(spark, write(tmp_path / "p.csv", "alpha,beta\n1,2\n"))


def test_csv_chosen_columns(spark, tmp_path):
    path = write(tmp_path / "p.csv", "alpha,beta\n1,2\n")
    assert rows(files.read_points_csv(spark, path, "alpha", "beta")) == [("unknown", None, 1.0, 2.0)]


def test_unsupported_suffix(spark):
    with pytest.raises(ValueError, match="Unsupported"):
        read_presence_file(spark, "points.xlsx")


def test_geojson(spark, tmp_path):
    document = {
        "type": "FeatureCollection",
        "features": [feature(11.4, 47.2, species="Lagopus", year=2020), feature(11.5, 47.25, species="Aquila", year=2021)],
    }
    assert rows(read_presence_file(spark, write(tmp_path / "p.geojson", json.dumps(document, indent=1)))) == EXPECTED


def test_documents_are_parsed_once(spark, tmp_path):
    """Names of properties, pieces, coordinate system and features all come from what one pass wrote."""
    point = {"type": "Feature", "properties": {"species": "s"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    path = write(tmp_path / "once.geojson", json.dumps({"type": "FeatureCollection", "features": [point] * 3}))
    found = geojson.read_documents(spark, path)
    assert found.count() == 3
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_geojson_header_is_chosen_for_the_file(spark, tmp_path):
    document = {"type": "FeatureCollection", "features": [feature(1, 2, Name="n"), feature(3, 4, SPECIES="s", Name="m")]}
    got = rows(read_presence_file(spark, write(tmp_path / "p.json", json.dumps(document))))
    assert got == [("s", None, 3.0, 4.0), (None, None, 1.0, 2.0)]


def test_geojson_in_metres(spark, tmp_path):
    document = {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}},
        "features": [feature(1113194.9079327357, 0, species="s")],
    }
    lon, lat = read_presence_file(spark, write(tmp_path / "p.geojson", json.dumps(document))).first()[2:]
    assert lon == pytest.approx(10) and lat == pytest.approx(0, abs=1e-9)
    document["crs"]["properties"]["name"] = "urn:ogc:def:crs:EPSG::31287"
    other = read_presence_file(spark, write(tmp_path / "q.geojson", json.dumps(document)))
    with pytest.raises(Exception, match="31287"):
        other.collect()


def awkward_document():
    """Braces, quotes and backslashes in strings, nested properties, other members before and after."""
    rng = random.Random(8)
    texts = ["}", "{[", '"', "\\", '\\"}', "a\\\\", "é \U0001f600 ]}", "", '{"type": "Feature"}', "features", "\n}\t"]
    features = []
    for i in range(120):
        extra = {"note": "".join(rng.choice(texts) for _ in range(rng.randint(0, 6))), "deep": {"a": [{"b": i}, "}"]}}
        features.append(feature(i / 10, -i / 20, species=f"s{i % 7}", year=2000 + i % 20, **extra))
    return {
        "name": "features", "bbox": [0, 1, 2, 3], "meta": {"features": [{"type": "Feature"}], "x": {"y": "}"}},
        "type": "FeatureCollection", "features": features,
        "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "after": [{"z": "]"}],
    }


@pytest.mark.parametrize("size, layout", [("64m", {"indent": 1}), ("6k", {"separators": (",", ":")}), ("2k", {"ensure_ascii": False})])
def test_documents_are_split_by_ranges(spark, tmp_path, monkeypatch, size, layout):
    monkeypatch.setattr(geojson, "_LOT", 2000)
    document = awkward_document()
    for i in range(2):
        (tmp_path / f"{i}.geojson").write_text(json.dumps(document, **layout) + "\n" * i, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = files.read_features(spark, str(tmp_path)).persist()
        assert found.count() == 240 and found.where("epsg = 84 and kind = 'Point'").count() == 240
        notes = sorted(r[0] for r in found.select(F.col("properties")["note"]).collect())
        assert notes == sorted(f["properties"]["note"] for f in document["features"] * 2)
        got = sorted(rows(files.read_points_geojson(spark, str(tmp_path))))
        assert got == sorted((f["properties"]["species"], f["properties"]["year"], *f["geometry"]["coordinates"]) for f in document["features"] * 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_document_takes_several_tasks(spark, tmp_path):
    document = {"type": "FeatureCollection", "features": [feature(i % 360 - 180, 1, species="s" * 50) for i in range(20_000)]}
    path = write(tmp_path / "big.geojson", json.dumps(document))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        fragments = geojson._fragments(spark, path)
        assert fragments.select(F.spark_partition_id()).distinct().count() >= 8
        assert files.read_points_geojson(spark, path).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_damaged_documents_stop_the_job(spark, tmp_path):
    whole = json.dumps({"type": "FeatureCollection", "features": [feature(i, i, species="s") for i in range(50)]})
    for name, text in (
        ("short", whole[:-40]), ("string", whole.replace('"s"', '"s', 1)), ("feature", whole.replace('"geometry":', '"geometry"', 1)),
        ("extra", whole + "}"),
    ):
        with pytest.raises(Exception, match="whole JSON|[Mm]alformed"):
            files.read_points_geojson(spark, write(tmp_path / f"{name}.geojson", text)).collect()


def bundle(path, prefix="", prj=None, columns=None):
    members = point_shapefile([11.4, 11.5], [47.2, 47.25], columns or {"species": ["Lagopus", "Aquila"], "year": [2020, 2021]})
    if prj:
        members["points.prj"] = prj.encode()
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(prefix + name, data)
    return str(path)


@pytest.mark.parametrize("prefix", ["", "folder/inner/"])
def test_shapefile_zip(spark, tmp_path, prefix):
    assert rows(read_presence_file(spark, bundle(tmp_path / "p.zip", prefix))) == EXPECTED


def test_shapefile_projection(spark, tmp_path):
    path = bundle(tmp_path / "p.zip", prj='PROJCS["WGS 84 / Pseudo-Mercator"]')
    assert read_presence_file(spark, path).first()["lon"] == pytest.approx(11.4 / 111319.490793)


def test_folder_of_shapefiles(spark, tmp_path):
    for i in range(3):
        bundle(tmp_path / f"{i}.zip")
    from nichegrid.sources.shapefiles import read_shapefile_zips

    assert read_shapefile_zips(spark, str(tmp_path)).count() == 6


def test_zip_without_shapefile(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("readme.txt", "nothing")
    with pytest.raises(Exception, match="no .shp"):
        read_presence_file(spark, str(tmp_path / "p.zip"))


def test_coordinate_headers():
    assert upload_coordinates(["LAT", "Lon", "x"]) == ("Lon", "LAT")
    assert upload_coordinates(["lon", "lat", "x", "y"]) == ("x", "y")
    assert upload_coordinates(["lon", "y"]) is None
    assert archive_coordinates(["x", "lat", "lon", "y"]) == ("lon", "lat")
    assert archive_coordinates(["y", "decimalLongitude"]) == ("decimalLongitude", "y")
    with pytest.raises(ValueError):
        archive_coordinates(["LON", "LAT"])


def archive(path, text, member="data.csv"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("citation.txt", "x")
        z.writestr(member, text)


def test_ingest_archives(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    archive(source / "a.zip", "recordID\tscientificName\tlat\tdecimalLongitude\n1\tAquila L.\t47.2\t11.4\n2\tB\tbad\t11\n")
    archive(source / "b.zip", "recordID\tscientificName\tlat\tdecimalLongitude\n3\tC\t1\t2\n", "x.tsv")
    table = archives.ensure_ingested(spark, str(source), target)
    assert {"recordID", "species", "scientificName", "year", "decimalLatitude", "decimalLongitude"} == set(table.columns)
    assert dict(table.dtypes)["year"] == "bigint"
    got = {r["recordID"]: (r["species"], r["year"], r["decimalLatitude"]) for r in table.collect()}
    assert got == {"1": ("Aquila L.", None, 47.2), "2": ("B", None, None), "3": ("C", None, 1.0)}
    archive(source / "c.zip", "recordID\tlat\tlon\n9\t1\t2\n")
    assert archives.ensure_ingested(spark, str(source), target).count() == 3  # built once


def test_archives_of_different_layouts(spark, tmp_path):
    archive(tmp_path / "a.zip", "k\tlat\n1\t2\n")
    archive(tmp_path / "b.zip", "lat\tk\textra col\n3\t4\t5\n")
    got = archives.read_archives(spark, str(tmp_path)).select("k", "lat", "`extra col`").collect()
    assert sorted(map(tuple, got)) == [("1", "2", None), ("4", "3", "5")]
    known = archives.read_archives(spark, str(tmp_path), ["k\tlat", "lat\tk\textra col"])
    assert known.count() == 2
    with pytest.raises(Exception, match="unexpected header"):
        archives.read_archives(spark, str(tmp_path), ["k\tlat"]).collect()


def test_archives_are_opened_once(spark, tmp_path, monkeypatch):
    source, log = tmp_path / "in", tmp_path / "opened"
    source.mkdir()
    for i in range(4):  # two layouts, and an archive without a line
        archive(source / f"{i}.zip", "k\tlat\n1\t2\n" if i % 2 else "lat\tk\tmore\n" + "3\t4\t5\n" * (i > 0))
    opened = archives._open_table

    def counted(content):
        with open(log, "a") as f:
            f.write("x")
        return opened(content)

    monkeypatch.setattr(archives, "_open_table", counted)
    table = archives.read_archives(spark, str(source))
    assert sorted(map(tuple, table.select("k", "lat", "more").collect()), key=str) == [("1", "2", None)] * 2 + [("4", "3", "5")]
    assert table.count() == 3 and table.where("more is not null").count() == 1
    assert log.read_text() == "xxxx"


def test_archive_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in" / "a.zip", "a\tb\n1\t2\n")
    with pytest.raises(ValueError, match="coordinate"):
        archives.ensure_ingested(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    (tmp_path / "none").mkdir()
    with zipfile.ZipFile(tmp_path / "none" / "a.zip", "w") as z:
        z.writestr("citation.txt", "x")
    with pytest.raises(ValueError):
        archives.ensure_ingested(spark, str(tmp_path / "none"), str(tmp_path / "out2"))


def test_extracted_table(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "species\tyear\ty\tx\nAquila\t2020\t47\t11\n")
    table = archives.standardise(archives.read_tables(spark, path))
    assert table.first().asDict() == {"species": "Aquila", "year": 2020, "decimalLatitude": 47.0, "decimalLongitude": 11.0}


def test_background_table(spark, tmp_path):
    text = """NDVI,elevation,.geo\n0.5,100,"{'type': 'Point', 'coordinates': [11.9, 47.4]}"\n,200,"{'type': 'Point', 'coordinates': [12.0, 47.5]}"\n"""
    out = files.read_background(spark, write(tmp_path / "b.csv", text), ["NDVI", "elevation"])
    assert sorted(map(tuple, out.collect()), key=str) == [(0.5, 100.0, 11.9, 47.4), (None, 200.0, 12.0, 47.5)]
    assert files.read_background(spark, str(tmp_path / "b.csv")).columns == ["NDVI", "elevation", "lon", "lat"]
    with pytest.raises(ValueError):
        files.read_background(spark, write(tmp_path / "c.csv", "a,b\n1,2\n"))
    with pytest.raises(Exception):
        files.read_background(spark, str(tmp_path / "missing.csv"))


def boundaries(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    island = [[[5, 5], [6, 5], [6, 6], [5, 5]]]
    document = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square},
             "properties": {"CNTR_CODE": "AT", "NUTS_NAME": "Tirol"}},
            {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [square, island]},
             "properties": {"CNTR_CODE": "DE", "NUTS_NAME": "Ober"}},
        ],
    }
    return regions.read_boundaries(spark, write(tmp_path / "b.geojson", json.dumps(document)), 2)


def test_boundaries(spark, tmp_path):
    edges = regions.boundary_edges(boundaries(spark, tmp_path))
    counts = {r["nuts_name"]: r["count"] for r in edges.groupBy("nuts_name").count().collect()}
    assert counts == {"Tirol": 4, "Ober": 7}


def test_area_choice(spark, tmp_path):
    table = boundaries(spark, tmp_path)
    assert regions.select_area(table, table, "AT").first()["nuts_name"] == "Tirol"
    assert regions.select_area(table, table, "AT", "Ober").first()["nuts_name"] == "Ober"  # the county wins
    with pytest.raises(ValueError):
        regions.select_area(table, table, "XX")
    with pytest.raises(ValueError):
        regions.select_area(table, table, "AT", "Nowhere")
    assert [r[0] for r in regions.region_options(table, "DE").collect()] == ["Ober"]


def test_export(spark, tmp_path):
    surface = spark.createDataFrame([(x, 0, None if x == 1 else x / 10) for x in range(3)], "cx long, cy long, score double")
    surfaces.export_surface(surface, str(tmp_path / "out"), 100, 100, fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("cx")
    assert [r["score"] for r in back.collect()] == ["0.0", "0.0", "0.2"]


RECORD = "key long, species string, scientificName string, year int, month int, decimalLongitude double, decimalLatitude double, countryCode string, hasCoordinate boolean, basisOfRecord string"


@pytest.fixture(scope="module")
def records(spark):
    data = [
        (i, "Lagopus muta", "Lagopus muta (Montin)", 2015 + i % 10 if i % 7 else None, 5, 11.0 + i / 100, 47.0, "AT" if i % 2 else "DE", i % 5 != 0, "HUMAN_OBSERVATION")
        for i in range(1000)
    ]
    return spark.createDataFrame(data, RECORD).persist()


def test_explore_is_limited_and_deepdive_is_not(records):
    few = occurrences.fetch_presences("explore", records, "Lagopus muta", "AT", 2015, 2024, limit=300)
    every = occurrences.fetch_presences("deepdive", records, "Lagopus muta", "AT", 2015, 2024)
    assert few.columns == every.columns == COLUMNS
    assert few.count() == 300 and every.count() > 300
    unlimited = occurrences.fetch_presences("explore", records, "Lagopus muta", "AT", 2015, 2024)
    assert unlimited.count() == every.count()
    assert every.where("year is null").isEmpty()


def test_no_match_keeps_the_schema(spark, records):
    none = occurrences.fetch_presences("deepdive", records, "Nobody", "AT", 2015, 2024)
    assert none.isEmpty() and none.columns == occurrences.empty_presences(spark).columns
    assert none.dtypes == occurrences.empty_presences(spark).dtypes


def test_own_treats_wildcards_as_text(records):
    assert occurrences.own(records, "GOPUS mu", 2015, 2024).count() > 0
    for text in ("%", "_", "x' OR '1'='1"):
        assert occurrences.own(records, text, 2015, 2024).isEmpty()


def test_modes(records):
    with pytest.raises(ValueError, match="mode"):
        occurrences.fetch_presences("upload", records, "a", "AT", 1, 2)
    with pytest.raises(ValueError, match="dataset_key"):
        occurrences.fetch_presences("own", records, "a", "AT", 1, 2)


def test_species_fallback(records):
    first = lambda df: df.first()["species"]
    assert first(occurrences.records_table(records, "q")) == "Lagopus muta"
    assert first(occurrences.records_table(records.drop("species"), "q")) == "Lagopus muta (Montin)"
    assert first(occurrences.records_table(records.drop("species", "scientificName"), "q")) == "q"


def test_cleanup_keeps_the_year_a_number(spark):
    df = spark.createDataFrame([(1, 2020, None)], "code int, year int, note string")
    out = occurrences.cleanup(df)
    assert dict(out.dtypes) == {"code": "string", "year": "int", "note": "string"}
    assert tuple(out.first()) == ("1", 2020, None)


def test_observations(records):
    assert occurrences.observations(records, "Lagopus muta", "AT").columns == ["species", "year", "month", "lon", "lat"]
    assert occurrences.observations(records, "Nobody", "AT") is None
    by_name = occurrences.observations(records.drop("species"), "Lagopus muta (Montin)", "AT")
    assert by_name.columns == ["species", "year", "month", "lon", "lat"] and not by_name.isEmpty()


def test_malformed_and_other_features_are_errors(spark, tmp_path):
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"species":"a"}}'
    line = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]},"properties":{}}'
    for name, bad in (("other", line), ("broken", '{"type": "Feature", "geometry"')):
        (tmp_path / f"{name}.json").write_text(f"{point}\n{bad}\n")
        with pytest.raises(Exception, match="not a point|[Mm]alformed"):
            files.read_points_geojson(spark, str(tmp_path / f"{name}.json"), lines=True).collect()


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from nichegrid import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_root(Session())


def test_year_partitions_are_pruned(spark, records, tmp_path):
    path = str(tmp_path / "by-year")
    occurrences.write_by_year(records, path)
    stored = occurrences.read_by_year(spark, path)
    found = occurrences.deepdive(stored, "Lagopus muta", "AT", 2016, 2017)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert found.count() == occurrences.deepdive(records, "Lagopus muta", "AT", 2016, 2017).count()
    (next((tmp_path / "by-year" / "year=2016").glob("*.parquet"))).write_bytes(b"broken")
    with pytest.raises(Exception, match="2016"):
        occurrences.read_by_year(spark, path).select("key").write.format("noop").mode("overwrite").save()


def jobs_of(spark, group, action):
    """What ``action`` returns, and how many jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        return action(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setJobGroup("other", "other")


def test_every_year_is_judged_in_one_scan(spark, records, tmp_path):
    path = tmp_path / "by-year"
    occurrences.write_by_year(records, str(path))
    expected = {r["year"]: r["n"] for r in occurrences.records_per_year(records).collect()}
    assert None in expected
    collect = lambda: {r["year"]: r for r in occurrences.year_status(spark, str(path)).collect()}
    status, many = jobs_of(spark, "ten years", collect)
    assert {y: r["n"] for y, r in status.items()} == expected and {r["status"] for r in status.values()} == {"read"}
    # a file that is no table, one that ends early, and one with a damaged page in the partition without a year
    next((path / "year=2016").glob("*.parquet")).write_bytes(b"broken")
    whole = next((path / "year=2018").glob("*.parquet")).read_bytes()
    next((path / "year=2018").glob("*.parquet")).write_bytes(whole[: len(whole) // 2])
    missing = next((path / "year=__HIVE_DEFAULT_PARTITION__").glob("*.parquet"))
    data = bytearray(missing.read_bytes())
    data[4:200] = bytes(196)
    missing.write_bytes(bytes(data))
    for crc in path.rglob(".*.crc"):
        crc.unlink()
    status, again = jobs_of(spark, "damaged years", collect)
    failed = {y for y, r in status.items() if r["status"].startswith("failed: part-")}
    assert failed == {2016, 2018, None} and all(status[y]["n"] is None for y in failed)
    assert all(status[y]["n"] == n for y, n in expected.items() if y not in failed)
    kept, told = occurrences.read_readable(spark, str(path), records.schema)
    assert kept.count() == sum(n for y, n in expected.items() if y not in failed) and told.count() == len(expected)
    few = tmp_path / "few"
    occurrences.write_by_year(records.where("year = 2015"), str(few))
    _, one = jobs_of(spark, "one year", lambda: occurrences.year_status(spark, str(few)).collect())
    assert many == again == one  # the years do not multiply jobs
    with pytest.raises(ValueError, match="partitioned"):
        occurrences.year_status(spark, str(few / "year=2015"))


def test_suggestions(spark):
    taxa = spark.createDataFrame(
        [("Lagopus muta", "x"), (None, "Lagopus lagopus L."), ("", "Lagurus"), ("Aquila", "y"), (None, None)] * 2,
        "canonicalName string, scientificName string",
    )
    assert [r[0] for r in occurrences.suggest(taxa, "LAG").collect()] == ["Lagopus lagopus L.", "Lagopus muta", "Lagurus"]
    assert occurrences.suggest(taxa, "L").isEmpty()
