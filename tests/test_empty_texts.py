"""Documents without text, which DuckDB counts in a row without position."""

import __spark_entry__ as entry
import duckdb


def test_base_content_with_empty_texts_is_as_in_sql(spark, tmp_path):
    texts = [(0, "acGT"), (1, ""), (2, None), (3, "aé😀\r\n"), (4, ""), (5, "NNa")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(entry.oracle_sql()["base_content_by_position"]).fetchall()
    got = [tuple(r) for r in entry.queries()["base_content_by_position"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[0] is None for r in got)
