from __future__ import annotations

from readloom.operators import counting as C
from readloom.plans import views
from readloom.streaming.counting import count_stream, totals

SF = "/root/testdata/sf0.001"


def test_stream_counts_what_the_batch_counts(spark, tmp_path):
    reads, features = views.reads(spark, SF), views.features(spark, SF).cache()
    reads.repartition(3).write.parquet(f"{tmp_path}/in")
    saved = spark.read.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"`{n}` {t}" for n, t in saved.dtypes)
    for _ in range(2):
        count_stream(spark, f"{tmp_path}/in", schema, features, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    want = C.count_table(C.assign(C.single_fragments(saved), features))
    assert sorted(map(tuple, totals(spark, f"{tmp_path}/out").select("key", "units").collect())) == sorted(map(tuple, want.select("key", "units").collect()))
