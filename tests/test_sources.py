import json
import zlib

import pytest
from pyspark.sql import functions as F

from test_kernels import dense_block
from tilewright.kernels import wire
from tilewright.operators.mapping import Rule
from tilewright.sources import binary, formats, text
from tilewright.streaming.features import converted, write_batches

COLLECTION = {
    "type": "FeatureCollection",
    "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}},
    "features": [
        {"type": "Feature", "id": "station-7", "geometry": {"type": "Point", "coordinates": [4.25, -3.5, 120]}, "properties": {"s": "x\"é", "n": 1, "f": 1.5, "b": True, "z": None, "l": [1, "a"]}},
        {"type": "Feature", "geometry": {"type": "MULTIPOLYGON", "coordinates": [[[[0, 0], [0, 1], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}},
        {"type": "Feature", "geometry": None, "properties": None},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[0, 0], [1, 1]]}, "properties": {"a": "b"}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]}, "properties": {"a": "c"}},
    ],
}


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(COLLECTION, indent=1))
    got = formats.read_features(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted(r.geom.typ for r in got) == [0, 1, 1, 1, 2, 2, 2, 3, 3] and {r.srid for r in got} == {"4326"}
    p = next(r.props for r in got if "id" in r.props)
    assert {k: v.t for k, v in p.items()} == {"s": "string", "n": "double", "f": "double", "b": "bool", "z": "null", "l": "string", "id": "string"}
    assert (p["s"].s, p["n"].d, p["l"].s) == ('x"é', 1.0, '[1,"a"]')
    polygons = [[(v.x, v.y) for v in r.geom.rings[0]] for r in got if r.geom.typ == 3]
    assert sorted(polygons) == [[(1, 1), (0, 1), (0, 0)], [(5, 5), (6, 5), (6, 6)]]
    with pytest.raises(Exception, match="coordinates are in 4326"):
        text.read_geojson(spark, str(tmp_path / "a.geojson"), srid="3857").collect()
    df = formats.read_features(spark, str(tmp_path / "a.geojson")).where("geom.typ > 0")
    for name in ("b.geojson", "b.geojsonseq"):
        formats.write_features(df, str(tmp_path / name))
        again = formats.read_features(spark, str(tmp_path / name))
        key = lambda r: str((r.geom, sorted((k, v) for k, v in r.props.items() if v.t != "null")))
        assert sorted(map(key, again.collect())) == sorted(map(key, df.collect()))
    for part in (tmp_path / "b.geojson").glob("part-*"):
        assert json.loads(part.read_text())["crs"]["properties"]["name"].endswith("CRS84")


def test_text_sequence(spark, tmp_path):
    feature = json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"k": "v"}})
    for name, body in (("a", f"\x1e{feature}\n\x1e{feature}\n"), ("b", f"\x1e{feature}\n\x1e{feature}"), ("c", f"\x1e{feature}\n\x1e{feature}\n\x1e")):
        (tmp_path / f"{name}.geojsonseq").write_text(body)
        assert formats.read_features(spark, str(tmp_path / f"{name}.geojsonseq")).count() == 2
    (tmp_path / "d.geojsonseq").write_text("\x1e{broken\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        text.read_geojsonseq(spark, str(tmp_path / "d.geojsonseq")).collect()


def test_delimited_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\tname\tlat\tlon\n1\tx\t42.5\t1.5\n2\t\t-1\t0\n")
    got = text.read_csv(spark, str(tmp_path / "a.csv"), lat=2, lon=3, sep="\t").orderBy("geom.rings").collect()
    assert [(r.geom.rings[0][0].x, r.geom.rings[0][0].y, r.props["name"].s, r.props["lat"].s) for r in got] == [(0, -1, "", "-1"), (1.5, 42.5, "x", "42.5")]
    (tmp_path / "b.csv").write_text("id,lat,lon\n1,2\n")
    with pytest.raises(Exception):
        text.read_csv(spark, str(tmp_path / "b.csv")).collect()


def test_feature_blocks(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(COLLECTION))
    df = formats.read_features(spark, str(tmp_path / "a.geojson")).where("geom.typ > 0").withColumn("props", F.map_filter("props", lambda _, v: v["t"] != "bool"))
    out = str(tmp_path / "f.blocks")
    formats.write_features(df, out)
    assert formats.read_features(spark, out).count() == df.count()
    formats.write_features(df, out)  # replaces
    df.write.format("featureblocks").option("blockfeatures", "2").mode("overwrite").save(out)
    again = formats.read_features(spark, out, rangebytes="40")
    assert again.rdd.getNumPartitions() > 1
    plain = lambda r: str((r.geom, r.srid, sorted((k, v.s or "", v.d) for k, v in r.props.items())))
    assert sorted(map(plain, again.collect())) == sorted(map(plain, df.collect()))
    with pytest.raises(Exception, match="cannot be stored"):
        formats.write_features(formats.read_features(spark, str(tmp_path / "a.geojson")).where("geom.typ > 0"), str(tmp_path / "g.blocks"))
    broken = tmp_path / "broken.blocks"
    broken.mkdir()
    whole = next(p for p in (tmp_path / "f.blocks").iterdir() if p.stat().st_size > 100).read_bytes()
    (broken / "x.blocks").write_bytes(whole[:-9])
    with pytest.raises(Exception, match="ends early"):
        formats.read_features(spark, str(broken)).collect()
    assert formats.read_features(spark, str(broken), mode="DROPMALFORMED").count() == 6
    formats.convert(spark, [out, str(tmp_path / "a.geojson")], str(tmp_path / "all.geojsonseq"), [Rule("a", (), {"k": 1})])
    assert formats.read_features(spark, str(tmp_path / "all.geojsonseq")).count() == 8
    lines = [r.value for r in formats.inspect(df, colour=False).collect()]
    assert "LineString (X: 0, Y: 0), (X: 1, Y: 1)" in lines
    with pytest.raises(ValueError):
        formats.format_of("x.unknown")


def test_extract(spark, tmp_path):
    def blob(kind, data):
        body = wire.number(2, len(data)) + wire.chunk(3, zlib.compress(data))
        head = wire.chunk(1, kind.encode()) + wire.number(3, len(body))
        return len(head).to_bytes(4, "big") + head + body

    path = tmp_path / "x.osm.pbf"
    path.write_bytes(blob("OSMHeader", b"") + blob("OSMData", dense_block()) * 2)
    binary.register(spark)
    nodes = spark.read.format("osmpbf").option("kind", "node").option("rangebytes", "10").load(str(path))
    assert nodes.count() == 4 and nodes.rdd.getNumPartitions() == 3
    got = formats.spatialize(spark, str(path), [Rule("highway", (), {}, {"class": ("highway", None)})]).collect()
    assert {r.props["class"].s for r in got} == {"primary"}


def test_streams(spark, tmp_path):
    feature = lambda k: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {k: "v"}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.geojsonseq").write_text(f"\x1e{feature('a')}\n\x1e{feature('b')}\n")
    stream = converted(text.stream_geojsonseq(spark, str(tmp_path / "in")), [Rule("a", (), {"x": 1})])
    for _ in range(2):
        write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in/b.geojsonseq").write_text(f"\x1e{feature('a')}\n")
    write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert formats.read_features(spark, str(tmp_path / "out"), "featureblocks").count() == 2


def test_programs(spark, tmp_path, capsys, monkeypatch):
    from tilewright.__main__ import box, main, zooms

    assert zooms("3, 1,,3") == [1, 3] and box("1,2,3,4") == (1, 2, 3, 4)
    (tmp_path / "a.geojson").write_text(json.dumps(COLLECTION))
    (tmp_path / "m.yml").write_text('- {src: {key: a, value: "*"}, dest: [{key: b, value: "$a"}]}')
    main(["convert", "--in", f"{tmp_path}/a.geojson,{tmp_path}/a.geojson", "--out", f"{tmp_path}/o.blocks", "--mapping", f"{tmp_path}/m.yml"], spark)
    (tmp_path / "p.csv").write_text("name,south,east\nx,1.5,2.5\ny,-1,0\n")
    main(["convert", "--in", f"{tmp_path}/p.csv,{tmp_path}/a.geojson", "--out", f"{tmp_path}/mixed.geojsonseq"], spark)
    assert formats.read_features(spark, f"{tmp_path}/mixed.geojsonseq").count() == formats.read_features(spark, f"{tmp_path}/a.geojson").count() + 2
    import io
    import types

    capsys.readouterr()
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO((tmp_path / "a.geojson").read_bytes())))
    main(["convert", "--in", "-", "--in-codec", "geojson", "--out", "-", "--out-codec", "geojson", "--mapping", f"{tmp_path}/m.yml"], spark)
    assert [f["properties"] for f in json.loads(capsys.readouterr().out)["features"]] == [{"b": "b"}] * 2 + [{"b": "c"}] * 2
    with pytest.raises(SystemExit):
        main(["convert", "--in", "-", "--out", "-"], spark)
    main(["inspect", f"{tmp_path}/o.blocks"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 8
    main(["tile", "--in", f"{tmp_path}/o.blocks", "--out", f"{tmp_path}/tiles", "--zoom", "0,2", "--bbox=-10,-10,10,10"], spark)
    assert (tmp_path / "tiles/0/0/0.mvt").exists()
    main(["tile", "--in", f"{tmp_path}/o.blocks", "--out", f"{tmp_path}/json", "--zoom", "0", "--codec", "geojson"], spark)
    assert len(json.loads((tmp_path / "json/0/0/0.geojson").read_text())["features"]) == 8
