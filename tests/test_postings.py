"""Posting lists against the filter over all paragraphs."""

import random

import pytest

from lexspark.operators import postings, store


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [("t", "2020", "c", h5, dan, f"text {h5} {dan}", sorted(rng.sample(["*A", "*B", "*C", "*D/x"], rng.choice([0, 1, 2, 4])))) for h5 in range(40) for dan in range(1, rng.randint(2, 9))]
    coded = spark.createDataFrame(rows, "municipality string, year string, category string, h5 bigint, dan bigint, text string, codes array<string>")
    t, path = store.build(coded), str(tmp_path_factory.mktemp("postings"))
    again = t["paragraph_codings"].unionByName(t["paragraph_codings"].limit(5))
    postings.write(t["paragraphs"], again, t["coding_types"], path, documents=4)
    return coded, path


@pytest.mark.parametrize("codes", [["*A"], ["*A", "*B"], ["*B", "*A", "*B"], ["*A", "*B", "*C", "*D/x"], ["*D/x"], ["*NONE"], ["*A", "*NONE"]])
def test_all_of_codes(spark, written, codes):
    coded, path = written
    want = {(r.h5 << 24) + r.dan: r.text for r in store.having_all(coded, codes).collect()}
    got = {r.id: r.text for r in postings.paragraphs_with(spark, path, codes).collect()}
    assert got == want and (want or "*NONE" in codes)


def test_only_folders_of_hits_are_read(spark, written):
    _, path = written
    with pytest.raises(ValueError, match="no codes"):
        postings.all_of(spark, path, [])
    plan = postings.paragraphs_with(spark, path, ["*A"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(code" in plan.replace("\n", "") or "code#" in plan  # lists by code
    before = spark.conf.get("spark.sql.optimizer.dynamicPartitionPruning.enabled", "true")
    assert before == "true" and "dynamicpruning" in plan.lower()  # paragraphs by bucket
