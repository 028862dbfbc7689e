import duckdb
import pytest
from pyspark import cloudpickle

import geofold

cloudpickle.register_pickle_by_value(geofold)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the small table, and cases of their own."""
    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    odd = [None, "", " \n\t ", "x", "ab" * 300, "é" * 120, rows[3][1], rows[3][1], rows[5][1][:400] + " tail " + rows[7][1][100:900], long, long + " end"]
    return rows + [(10_000 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(odd)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6).cache()
