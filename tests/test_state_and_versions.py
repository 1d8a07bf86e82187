"""First-wins over arriving files, and edits that rewrite only the files they touch."""

import glob
import hashlib
import os
import shutil

import pytest
from pyspark.sql import functions as F

from lexspark.operators import aggregates
from lexspark.operators.snapshots import Snapshots
from lexspark.streaming import first_wins

SCHEMA = "town string, year int, place bigint, text string, score double"


def arriving(step):
    """Rows of one file; later files have smaller places for some keys, which must not win."""
    rows = [(f"t{k % 7}" if k % 11 else None, 2014 + k % 3, 1000 * (3 - step) + k, f"text {step} {k} ü\n\"q\"" if k % 5 else None, k / 3) for k in range(step * 10, step * 10 + 60)]
    return rows + rows[:5]  # repeated whole


@pytest.mark.parametrize("broken", [False, True])
def test_first_rows_survive_restarts(spark, tmp_path, broken, monkeypatch):
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    key, order = ["town", "year"], ["place"]
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    for step in range(3):
        spark.createDataFrame(arriving(step), SCHEMA).coalesce(1).write.option("ignoreNullFields", False).mode("append").json(source)
        if broken and step == 1:
            # The batch fails after its rows are written and before it is committed; the restart runs it again.
            real = first_wins.StreamingQuery and first_wins.first_rows

            def failing(*a, real=real):
                return real(*a).withColumn("new", F.when(F.col("n_rows") >= 0, F.raise_error("lost")).otherwise(F.col("new")).cast("boolean"))

            monkeypatch.setattr(first_wins, "first_rows", failing)
            with pytest.raises(Exception, match="lost"):
                first_wins.keep_first_rows(stream(), key, order, out, str(tmp_path / "checkpoint")).awaitTermination()
            monkeypatch.setattr(first_wins, "first_rows", real)
        first_wins.keep_first_rows(stream(), key, order, out, str(tmp_path / "checkpoint")).awaitTermination()
    # The batch result, with the file that a row came in as its first rank.
    whole = [(step, *r) for step in range(3) for r in arriving(step)]
    want = aggregates.first_wins(spark.createDataFrame(whole, "step int, " + SCHEMA), key, ["step", "place"]).drop("step")
    got = first_wins.kept_rows(spark, out, key)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_existing_keys_are_never_new(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(arriving(0), SCHEMA).write.json(source)
    there = spark.createDataFrame([("t1", 2014, 0, "old", 1.0), (None, 2014, 0, "old", 1.0)], SCHEMA)
    first_wins.keep_first_rows(spark.readStream.schema(SCHEMA).json(source), ["town", "year"], ["place"], out, str(tmp_path / "c"), there).awaitTermination()
    want = aggregates.first_wins(spark.createDataFrame(arriving(0), SCHEMA), ["town", "year"], ["place"])
    keys = {(r.town, r.year) for r in want.collect()} - {("t1", 2014), (None, 2014)}
    assert {(r.town, r.year) for r in first_wins.kept_rows(spark, out, ["town", "year"]).collect()} == keys


def digests(root):
    return {os.path.relpath(p, root): hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{root}/data-*/*.parquet")}


def test_edits_rewrite_only_touched_files(spark, tmp_path):
    root = str(tmp_path / "docs")
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("kind"))
    t = Snapshots(spark, f"file://{root}")
    t.create(docs.repartitionByRange(10, "doc_id"))
    with pytest.raises(FileExistsError):
        t.create(docs)
    before, first = digests(root), t.newest()["files"]
    change = spark.createDataFrame([(3, "new 3"), (4, None)], "doc_id bigint, value string")
    assert t.edit("e1", "doc_id", "text", change, F.lit("2020-01-01"))
    after, now = digests(root), t.newest()
    assert {k: after[k] for k in before} == before  # byte for byte, the old version's files too
    assert len(set(first) & set(now["files"])) == 9 and len(set(first) - set(now["files"])) == 1
    rows = {r.doc_id: (r.text, r.previous, r.edited_at) for r in t.read().collect()}
    assert len(rows) == 100 and rows[3] == ("new 3", "text 3", "2020-01-01") and rows[4] == (None, "text 4", "2020-01-01") and rows[5] == ("text 5", None, None)
    assert {r.doc_id: r.text for r in t.read(1).collect()} == {i: f"text {i}" for i in range(100)}
    # The same edit again does nothing; a second edit keeps the first one's stamps.
    assert not t.edit("e1", "doc_id", "text", change, F.lit("2021-01-01")) and t.newest() == now
    assert t.edit("e2", "doc_id", "text", spark.createDataFrame([(3, "newer"), (99, "end")], "doc_id bigint, value string"), F.lit("2022-01-01"))
    rows = {r.doc_id: (r.text, r.previous, r.edited_at) for r in t.read().collect()}
    assert rows[3] == ("newer", "new 3", "2022-01-01") and rows[4] == (None, "text 4", "2020-01-01") and rows[99] == ("end", "text 99", "2022-01-01")
    assert t.versions.numbers() == [1, 2, 3]


def test_edits_that_fail_change_nothing(spark, tmp_path, monkeypatch):
    t = Snapshots(spark, f"file://{tmp_path}/docs")
    t.create(spark.range(20).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(4))
    now = t.newest()
    for rows in ([(5, "a"), (77, "b")], [(5, "a"), (5, "b")]):
        with pytest.raises(Exception, match="no such document|changed twice"):
            t.edit("bad", "doc_id", "text", spark.createDataFrame(rows, "doc_id bigint, value string"), F.lit("t"))
        assert t.newest() == now and t.read().filter("text <> 'x'").count() == 0
    # A driver that is lost before it publishes: the files are there, the version is not, and the edit can be made again.
    real = t.versions.publish
    monkeypatch.setattr(t.versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    change = spark.createDataFrame([(5, "a")], "doc_id bigint, value string")
    with pytest.raises(RuntimeError, match="lost"):
        t.edit("e", "doc_id", "text", change, F.lit("t"))
    assert t.newest() == now
    monkeypatch.setattr(t.versions, "publish", real)
    assert t.edit("e", "doc_id", "text", change, F.lit("t")) and t.read().filter("text = 'a'").count() == 1


def test_two_edits_at_once_both_count(spark, tmp_path, monkeypatch):
    """Another edit is published while this one has written its files: it starts again from the newer version."""
    t, other = (Snapshots(spark, f"file://{tmp_path}/docs") for _ in range(2))
    t.create(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1))
    real, change = t.versions.publish, lambda k, v: spark.createDataFrame([(k, v)], "doc_id bigint, value string")

    def late(number, content):
        if number == 2:
            other.edit("theirs", "doc_id", "text", change(1, "theirs"), F.lit("t"))
        return real(number, content)

    monkeypatch.setattr(t.versions, "publish", late)
    assert t.edit("ours", "doc_id", "text", change(2, "ours"), F.lit("t"))
    assert {r.doc_id: r.text for r in t.read().filter("text <> 'x'").collect()} == {1: "theirs", 2: "ours"} and t.newest()["edits"] == ["theirs", "ours"]
    shutil.rmtree(tmp_path / "docs")
