import pytest
from pyspark.sql import functions as F

from geofold.plans import bake, region_bake as rb
from geofold.plans.views import Inputs
from geofold.sources.pass_store import PassStore

SF = "/root/testdata/sf0.001"


def chunks_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "cx bigint, cz bigint")


def test_store_does_what_is_missing(spark, tmp_path):
    store, made = PassStore(spark, str(tmp_path / "s")), []

    def make(name, rows):
        def fn(todo):
            made.append((name, sorted(tuple(r) for r in todo.collect())))
            return todo.withColumn("v", F.lit(rows))

        return fn

    all_ = chunks_of(spark, (0, 0), (0, 1), (1, 0))
    store.run(all_, "terrain", make("terrain", 1))
    store.run(all_, "hydro", make("hydro", 2), "terrain")
    assert sorted(tuple(r) for r in store.run(all_, "hydro", make("hydro", 3), "terrain").collect()) == [(0, 0, 2), (0, 1, 2), (1, 0, 2)]
    assert [n for n, _ in made] == ["terrain", "hydro"]  # nothing to do the third time
    store.forget(chunks_of(spark, (0, 1)), "terrain")
    store.run(all_, "terrain", make("terrain", 4))
    out = store.run(all_, "hydro", make("hydro", 5), "terrain")
    assert made[2:] == [("terrain", [(0, 1)]), ("hydro", [(0, 1)])]  # the pass that stands on it is stale, too
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, 2), (0, 1, 5), (1, 0, 2)]
    newer = PassStore(spark, str(tmp_path / "s"), versions={"hydro": 2})
    newer.run(all_, "hydro", make("hydro", 6), "terrain")
    assert made[-1] == ("hydro", [(0, 0), (0, 1), (1, 0)])


def test_unfinished_attempts_do_not_count(spark, tmp_path):
    store = PassStore(spark, str(tmp_path / "s"))

    def broken(todo):
        return todo.withColumn("v", F.when(F.col("cx") == 1, F.raise_error(F.lit("lost"))).cast("int"))

    both = chunks_of(spark, (0, 0), (1, 0))
    with pytest.raises(Exception, match="lost"):
        store.run(both, "terrain", broken)
    both.withColumn("v", F.lit(9)).write.parquet(f"{store.path}/rows/terrain/v1/attempt=dead")  # rows without an entry
    assert store.missing(both, "terrain").count() == 2
    assert {r["v"] for r in store.run(both, "terrain", lambda todo: todo.withColumn("v", F.lit(1))).collect()} == {1}


def test_bake_resumes_by_chunk(spark, tmp_path, monkeypatch):
    """Some chunks of a middle pass are taken away; only they and what stands on them are made again, with equal rows."""
    t = Inputs(spark, SF)
    sources, grid = bake.full_sources(t)
    done = []
    monkeypatch.setattr(rb, "hydro_pass", lambda runs, columns, *_: done.append(("hydro", columns.select("cx").distinct().count())) or runs)
    monkeypatch.setattr(rb, "road_pass", lambda runs, columns, *_: done.append(("roads", columns.select("cx").distinct().count())) or runs)
    path = str(tmp_path / "bake")
    store = rb.region_bake(path, sources, grid, bake.ORIGIN)
    first = {n: sorted(map(tuple, store.read(n).collect())) for n in rb.CHAIN}
    assert [n for n, _ in done] == ["hydro", "roads"] and done[0][1] > 2 and first["objects"]
    ground = {(r["cx"], r["cz"], r["vx"], r["vz"]): r["ground_y"] for r in rb.ag.column_ground(store.read("feature_rules"), rb.COLUMN).collect()}
    for r in store.read("objects").collect():
        assert r["y"] == ground[r["cx"], r["cz"], r["vx"], r["vz"]]
    edited = sources.edits.where("material <> 'AIR'").join(sources.columns, ["vx", "vz"]).select("vx", "vz", "vy", "material").limit(20).collect()
    last = store.read("feature_rules").collect()
    for e in edited:
        assert any((r["vx"], r["vz"], r["material"]) == (e["vx"], e["vz"], e["material"]) and r["y0"] <= e["vy"] <= r["y1"] for r in last)
    rb.region_bake(path, sources, grid, bake.ORIGIN)
    assert len(done) == 2
    store.forget(chunks_of(spark, (0, 0), (2, 0)), "hydro")
    store = rb.region_bake(path, sources, grid, bake.ORIGIN)
    assert done[2:] == [("hydro", 2), ("roads", 2)]
    assert {n: sorted(map(tuple, store.read(n).collect())) for n in rb.CHAIN} == first
    listed = rb.manifest(store, path, "R0")
    assert listed.count() == store.read("feature_rules").select("cx", "cz", F.explode(rb.co.layer_of("y0", "y1"))).distinct().count()
