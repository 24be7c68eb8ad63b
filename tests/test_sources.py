"""Remote schemas, numpy files, stored vectors."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.ml import store
from sparkloom.sources import files


def test_tables_of_a_remote_schema(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    rows.write.jdbc(url, "APP.ITEMS")
    rows.limit(3).write.jdbc(url, "APP.OTHERS")
    assert files.import_foreign_schema(spark, url, "APP", prefix="far_") == ["far_items", "far_others"]
    assert files.import_foreign_schema(spark, url, "APP", only=["items"]) == ["items"]
    assert spark.sql("SELECT name FROM far_items WHERE id = 7").first()[0] == "n7"
    parts = files.read_jdbc(spark, url, "APP.ITEMS", partition="ID", low=0, high=20, parts=4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 20


def test_numpy_files(spark, tmp_path):
    m = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = {r["row"]: r["values"] for r in files.read_numpy(spark, f"file://{tmp_path}/m.npy").collect()}
    assert got == {i: list(m[i]) for i in range(4)}


def test_forms_of_stored_vectors(spark):
    s = store.VectorStore(spark)
    df = spark.createDataFrame([(1, [0.1, -2.5, 0.0, 1000.0])], "id int, v array<double>")
    s.save("h", df, "half")
    assert s.load("h").first()["v"] == [float(np.float16(x)) for x in (0.1, -2.5, 0.0, 1000.0)]
    s.save("d", df, "delta", base=F.array(*[F.lit(float(x)) for x in (0, -2, 0, 999)]), tolerance=0.01)
    assert max(abs(a - b) for a, b in zip(s.load("d").first()["v"], [0.1, -2.5, 0.0, 1000.0], strict=True)) <= 0.005 + 1e-9
    with pytest.raises(ValueError):
        s.save("x", df, "float4")
