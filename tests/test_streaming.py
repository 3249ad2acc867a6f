from __future__ import annotations

from paxlens.schemas import SOURCE_FILES
from paxlens.streaming.landing import graph_stream, source_stream, write_graphs


def test_landing(spark, tmp_path):
    land, out, ck = (str(tmp_path / x) for x in ("land", "out", "ck"))
    one = spark.createDataFrame([("p", "benign", "a.js", 4, "f(1)"), ("p", "benign", "x.txt", 1, "x")], SOURCE_FILES)
    for k in range(2):
        one.write.mode("append").parquet(land)
        write_graphs(graph_stream(source_stream(spark, land)), out, ck).awaitTermination(60)
        assert spark.read.parquet(out).count() == k + 1
