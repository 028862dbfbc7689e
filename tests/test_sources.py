import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.operators import elevation as el, features as ft
from geofold.sources import readers, sinks
from geofold.functions import rules


def test_hgt_tile_round_trip(spark, tmp_path):
    side = 1201
    lat = np.linspace(-27, -28, side)[:, None]
    lon = np.linspace(153, 154, side)[None, :]
    d2 = (lat + 27.5) ** 2 + (lon - 153.2) ** 2
    z = np.where(np.sqrt(d2) < 0.2, 10 + 200 * np.exp(-d2 / (2 * 0.05**2)), 10).astype(">i2")
    (tmp_path / "S28E153.hgt").write_bytes(z.tobytes())
    px = readers.read_dem_hgt(spark, str(tmp_path))
    assert px.count() == side * side
    row = px.where("prow = 600 and pcol = 240").collect()[0]
    assert (row["tile_lat"], row["tile_lon"], row["elev_m"]) == (-28, 153, int(z[600, 240]))
    pts = spark.createDataFrame([(1, -27.5, 153.2), (2, -27.9, 153.9)], "id bigint, lat double, lon double")
    got = {r["id"]: r["z"] for r in el.dem_sample(pts, px, ["id"], side).collect()}
    assert abs(got[1] - 210) < 2 and got[2] == 10.0


def test_tile_names(spark):
    names = ["a/N28E153.hgt", "a/srtm_s28_e153.tif", "x/Cop_DSM_10_S28_00_W153_00_DEM.tif", "a/readme.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string").select(readers.tile_corner("path").alias("k"))
    assert [(r["k"]["lat"], r["k"]["lon"]) for r in df.collect()] == [(28, 153), (-28, 153), (-28, -153), (None, None)]


def test_coastline_levels_and_wrap(spark, tmp_path):
    def record(i, level, pts):
        flat = [v for p in pts for v in p]
        return struct.pack(">11i", i, len(pts), level, 0, 0, 0, 0, 0, 0, 0, 0) + struct.pack(f">{len(flat)}i", *flat)

    ring = [(206_000_000, -27_000_000), (207_000_000, -27_000_000), (207_000_000, -28_000_000)]
    (tmp_path / "shore.b").write_bytes(record(1, 1, ring) + record(2, 2, ring))
    out = readers.read_coastline(spark, str(tmp_path), (-30, -20, -160, -150)).collect()
    assert [r["poly_id"] for r in out] == [1] and out[0]["pts"][0]["lon"] == -154.0
    assert readers.read_coastline(spark, str(tmp_path), (10, 20, -160, -150)).count() == 0


def test_element_document(spark, tmp_path):
    nodes = [{"type": "node", "id": i, "lat": -27.47 + 0.001 * (i // 2), "lon": 153.02 + 0.001 * (i % 2)} for i in range(4)]
    nodes.append({"type": "node", "id": 9, "lat": 0.0, "lon": 0.0, "tags": {"amenity": "bench"}})
    ring = [0, 1, 3, 2, 0]
    ways = [
        {"type": "way", "id": 100, "nodes": ring, "tags": {"building": "yes", "height": "18m", "building:levels": "5"}},
        {"type": "way", "id": 101, "nodes": ring, "tags": {"building": "yes"}},
        {"type": "way", "id": 200, "nodes": [0, 3], "tags": {"highway": "motorway", "bridge": "yes", "layer": "1"}},
        {"type": "way", "id": 300, "nodes": ring, "tags": {"natural": "water"}},
        {"type": "way", "id": 400, "nodes": ring, "tags": {"leisure": "park"}},
        {"type": "way", "id": 500, "nodes": [0, 77], "tags": {"highway": "primary"}},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"version": 0.6, "generator": "t", "elements": nodes + ways}))
    tables = readers.read_overpass_elements(spark, str(tmp_path / "e.json"))
    nodes_ = tables["node"].withColumnRenamed("id", "node_id")
    geo = ft.way_geometry(readers.way_nodes(tables["way"]), nodes_).join(tables["way"].selectExpr("id as way_id", "tags"), "way_id")
    out = ft.classify_ways(geo)
    assert sorted((r["way_id"], r["layer"]) for r in out.collect()) == [
        (100, "buildings"), (101, "buildings"), (200, "roads"), (300, "water"), (400, "land_areas"), (400, "parks")]
    heights = {r["way_id"]: r["h"] for r in out.where("layer = 'buildings'").select("way_id", rules.building_height("tags").alias("h")).collect()}
    assert heights == {100: 18.0, 101: 6.0}
    assert [r["layer"] for r in ft.classify_nodes(tables["node"]).collect()] == ["amenities"]


def test_pass_versions_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "chunk bigint, payload string")
    path = str(tmp_path / "store")
    sinks.write_pass(df, path, "terrain")
    sinks.write_pass(df.where("chunk < 4"), path, "roads")
    sinks.write_pass(df, path, "hydro", version=0)
    store = spark.read.parquet(path)
    assert sinks.read_pass(store, "hydro").count() == 0
    assert sinks.resume_missing(df.select("chunk"), store, "roads").count() == 2
    assert {r["chunk"]: r["pass"] for r in sinks.best_pass(store).collect()}[5] == "terrain"
    sinks.write_pass(df.limit(1), path, "roads")
    assert sinks.read_pass(spark.read.parquet(path), "roads").count() == 1


def test_hgt_box_opens_its_tiles_alone(spark, tmp_path):
    import numpy as np

    from geofold.sources import hgt

    side, rnd = 301, np.random.default_rng(5)
    grids = {(lat, lon): rnd.integers(-50, 900, (side, side)).astype(">i2") for lat in (-28, -27, 3) for lon in (152, -7)}
    tiles = spark.createDataFrame([(lat, lon, g.tobytes()) for (lat, lon), g in grids.items()], "lat bigint, lon bigint, content binary").repartition(3)
    path = str(tmp_path / "dem")
    assert hgt.write_hgt(tiles, path) == 6
    (tmp_path / "dem" / "notes.txt").write_text("no tile")
    px = hgt.read_hgt(spark, path, [side])
    assert px.count() == 6 * side * side
    box = px.where("tile_lat between -28 and -27 and tile_lon = 152 and elev_m > 100")
    assert {(r["tile_lat"], r["tile_lon"]) for r in box.select("tile_lat", "tile_lon").distinct().collect()} == {(-28, 152), (-27, 152)}
    assert box.count() == sum(int((grids[k] > 100).sum()) for k in ((-28, 152), (-27, 152)))
    got = {(r["prow"], r["pcol"]): r["elev_m"] for r in px.where("tile_lat = 3 and tile_lon = -7 and prow in (0, 255, 256, 300)").collect()}
    assert len(got) == 4 * side and all(v == grids[3, -7][k] for k, v in got.items())
    reader = hgt.HgtReader({"path": path, "sides": str(side)})
    left = list(reader.pushFilters([hgt.EqualTo(("tile_lat",), 3), hgt.GreaterThan(("elev_m",), 5)]))
    assert len(left) == 1 and {(p.lat, p.top) for p in reader.partitions()} == {(3, 0), (3, 256)}
    # The filter reaches the source, so the plan's scan has the partitions of two tiles.
    assert px.where("tile_lat = -28").rdd.getNumPartitions() == 4
    (tmp_path / "dem" / "N10E010.hgt").write_bytes(b"123")
    with pytest.raises(Exception, match="bytes"):
        hgt.read_hgt(spark, path, [side]).count()


def test_z_order_interleaves_bits(spark):
    places = [(0, 0), (-1, 5), (7, -9), (2**30 - 1, -2**30), (-2**30, 2**30 - 1), (123456, -654321)]
    want = [sum(((v + 2**30) >> b & 1) << 2 * b + i for i, v in enumerate(p) for b in range(31)) for p in places]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, x bigint, y bigint")
    assert [r[0] for r in df.orderBy("i").select(sinks.z_order("x", "y")).collect()] == want


def test_op_chunks_are_clustered(spark, tmp_path):
    """Whole rows come back, files keep to their size, a hot chunk is split, a box lies in few files, replay order holds."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    n = 4000
    far = rng.integers(-4000, 4000, (n, 2)) * (rng.random((n, 1)) > 0.33)  # a third of all ops in one place
    rows = [(i, int(rng.integers(9)), int(rng.integers(500)), int(x), 0, int(z), "AB"[i % 2]) for i, (x, z) in enumerate(far)]
    ops = spark.createDataFrame(rows + rows[:50], "op_id bigint, author bigint, lamport bigint, vx bigint, vy bigint, vz bigint, material string")
    path = str(tmp_path / "ops")
    sinks.write_op_chunks(ops, path, file_rows=150)
    back = spark.read.parquet(path)
    want = sinks.ops_by_chunk(sinks.dedup_signature(ops))
    assert back.columns == want.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect())) and back.count() >= n
    files = [pq.read_table(f).to_pylist() for f in sorted((tmp_path / "ops").glob("part-*.parquet"))]
    assert len(files) >= n // 150 and max(map(len, files)) <= 150
    seen = {}
    for r in (r for f in files for r in f):
        now = (r["lamport"], r["author"], r["op_id"])
        assert seen.get((r["cx"], r["cz"]), now) <= now
        seen[r["cx"], r["cz"]] = now
    hot = max(seen, key=lambda c: sum((r["cx"], r["cz"]) == c for f in files for r in f))
    spans = [(min(r[k] for r in f), max(r[k] for r in f)) for f in files for k in ("cx", "cz")]
    holds = lambda i, c: all(lo <= v <= hi for (lo, hi), v in zip(spans[2 * i:2 * i + 2], c))
    assert sum(any((r["cx"], r["cz"]) == hot for r in f) for f in files) > 5
    others = [c for c in seen if c != hot][::40]
    assert sum(holds(i, c) for c in others for i in range(len(files))) < len(others) * len(files) / 4


def test_tiles_of_one_split_are_decoded_by_several_tasks(spark, monkeypatch):
    """A table of small tile files fits one split, but its pixels are dealt to tasks; batches of mixed sizes keep their places."""
    monkeypatch.setattr(readers, "BATCH_PIXELS", 10_000)
    rng = np.random.default_rng(5)
    tiles = {(lat, lon): rng.integers(-500, 500, (side, side)).astype(">i2") for lat in range(-4, 4) for lon, side in ((-3, 33), (7, 33), (9, 130))}
    name = lambda lat, lon: f"a/{'S' if lat < 0 else 'N'}{abs(lat):02d}{'W' if lon < 0 else 'E'}{abs(lon):03d}.hgt"
    files = spark.createDataFrame([(name(*k), bytearray(v.tobytes())) for k, v in tiles.items()], "path string, content binary").coalesce(1)
    px = readers.decode_hgt(files, sides=(33, 130)).withColumn("task", F.spark_partition_id())
    got = px.toPandas()
    assert got["task"].nunique() > 1 and len(got) == sum(v.size for v in tiles.values())
    for k, part in got.groupby(["tile_lat", "tile_lon"]):
        assert (tiles[k][part["prow"], part["pcol"]] == part["elev_m"]).all() and len(part.drop_duplicates(["prow", "pcol"])) == tiles[k].size
