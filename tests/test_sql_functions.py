import time

from pyspark.sql import functions as F

from geofold.functions import sql_functions as sf
from geofold.streaming import jobs
from geofold.streaming.progress import watch
from geofold.streaming.runner import parquet_stream

VALUES = {"double": [0.0, 1.5, -27.4, 153.03, 1200.25, None], "bigint": [0, 7, -31, 6_400_000, None], "string": ["Motorway", "Path", "?", None]}


def test_sql_functions_equal_the_columns(spark):
    """Every function by its SQL name against the Column form, over values, edges and nulls."""
    names = sf.register_functions(spark, "gf_")
    assert len(names) == len(sf.FUNCTIONS) > 20
    for name, (fn, arguments) in sf.FUNCTIONS.items():
        rows = []
        for i in range(12):
            rows.append([{"height": "12.5", "building:levels": str(i)} if kind.startswith("map") else VALUES[kind][(i * (k + 1) + k) % len(VALUES[kind])] for k, (_, kind) in enumerate(arguments)])
        df = spark.createDataFrame(rows, ", ".join(f"{a} {kind}" for a, kind in arguments))
        args = [a for a, _ in arguments]
        both = df.select(fn(*[F.col(a) for a in args]).alias("a"), F.expr(f"gf_{name}({', '.join(args)})").alias("b"))
        assert all(r["a"] == r["b"] or repr(r["a"]) == repr(r["b"]) for r in both.collect()), name
    plan = spark.sql("select gf_haversine_m(-27.5D, 153D, -27.4D, 153D + id) from range(9)")._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert spark.sql("select gf_haversine_m(-27.5D, 153D, -27.5D, 153D) d").first()["d"] == 0


def test_progress_of_a_stream(spark, tmp_path):
    path, seen = str(tmp_path / "o"), watch(spark)
    try:
        spark.createDataFrame([(i, 1, i, 0, 0, 0, "A", None) for i in range(30)], "op_id bigint, author bigint, lamport bigint, vx bigint, vy bigint, vz bigint, material string, ts timestamp").repartition(3).write.parquet(path)
        jobs.stream_lww(parquet_stream(spark, path, files_per_trigger=1)).count()
        end = time.time() + 20
        while time.time() < end and not seen.ended:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert sum(b["rows"] for b in seen.batches) == 30 and list(seen.ended.values()) == [None]
