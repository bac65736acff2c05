"""Planted introns and deletions that bases beside them, by chance, made ambiguous: no mapper could tell them."""

import __spark_entry__ as entry
import pytest


@pytest.mark.parametrize(("name", "ids", "want"), [
    ("found_junctions", (4768, 9662), [("left", {800}), ("right", {1601})]),
    ("reads_over_annotated_introns", (30513,), [("cigar", {"92M800N8M", "8M800N92M"})]),
    ("reads_over_known_events", (4290, 5171, 6066, 6186, 9646), [("deleted", {0, 4}), ("before", {False, None})]),
])
def test_planted_events_have_one_place(spark, tmp_path, name, ids, want):
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    for column, values in want:
        assert {r[column] for r in got} == values
    if "deleted" in got[0]:
        assert sum(r["rid"].endswith(":deleted") and r["deleted"] == 4 for r in got) == len(ids)


def test_foreign_bases_fit_with_no_gap(spark, tmp_path):
    # among 51,282 contigs these had foreign bases that fitted beside a gap
    spark.createDataFrame([(i, "x") for i in (16420, 25524, 33339, 34573, 43297, 45940, 50880)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["rid"]: r for r in entry.queries()["clipped_reads_in_place"](spark, str(tmp_path)).collect()}
    assert len(got) == 35
    for rid, r in got.items():
        n, kind = 5 + int(rid.split(":")[0]) % 26, rid.split(":")[1]
        head, tail = n if kind in ("head", "both") else 0, {"tail": n, "both": 20}.get(kind, 0)
        assert (r["pos"], r["head"], r["tail"], r["gaps"], r["nm"]) == (301 + head, head, tail, 1 + n % 3 if kind == "deleted" else 0, 3 if kind == "wrong" else 0)
