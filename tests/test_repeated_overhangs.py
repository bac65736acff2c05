"""A random contig may hold the bases of a planted overhang a second time, before another donor: then a read has two places that fit."""

import __spark_entry__ as entry
import duckdb
from pyspark.sql import functions as F

from readloom.plans import mapping_queries as M


def _documents(spark, tmp_path, ids):
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))


def test_an_overhang_stands_nowhere_else(spark, tmp_path):
    _documents(spark, tmp_path, (23237, 7, 30513))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(entry.oracle_sql()["reads_over_known_events"]).fetchall()
    got = [tuple(r) for r in entry.queries()["reads_over_known_events"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_no_word_over_an_event_is_in_a_contig(spark, tmp_path):
    _documents(spark, tmp_path, range(2000))
    seq = F.expr(M.UNREPEATED.format("substr(seq, 1, 1999) || 'ACATCGGTTGAAGC' || substr(seq, 2014)")).alias("seq")
    for s in (r["seq"] for r in M._spliced_contigs(spark, str(tmp_path)).select(seq).collect()):
        assert len(s) == 2560 and s[792:807] == "GTTGTGTTGTTGGTG" and s[1593:1608] == "CAACCAGCACCAACA" and s[1999:2013] == "ACATCGGTTGAAGC"
        for joined, cut, beyond in ((s[785:800] + s[1600:1615], 15, 15), (s[1985:2000] + s[2004:2013], 15, 9)):
            over = {joined[i : i + 16] for i in range(len(joined) - 15) if i < cut < i + 16 and (beyond == 15 or i + 16 - cut >= 6)}
            assert over and not any(word in s for word in over)
