"""Sources, sinks and streams, in temporary folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpuschain.sources import io
from corpuschain.streaming import events


def test_json_lines_and_corpus(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"book_id": 2, "matn": "x"}\n\n{"book_id": 3}\nnot json\n')
    (tmp_path / "a.jsonl").write_text('{"book_id": 1, "matn": "y", "other": 5}\n')
    rows = io.corpus(spark, str(tmp_path)).orderBy("file", "book_id").collect()
    assert [(r["file"], r["book_id"], r["matn"]) for r in rows] == [("a.jsonl", 1, "y"), ("b.jsonl", 2, "x"), ("b.jsonl", 3, None)]


def test_books_and_catalogue(spark, tmp_path):
    book = {"book_id": 7, "name": "n", "indexes": {"numbers": {"1": 3, "2": 5}, "headings": [{"page": 3, "level": 1, "title": "t"}]}, "pages": [{"pg": i, "meta": {"page": i, "vol": "1"}, "text": f"p{i}"} for i in range(1, 6)]}
    (tmp_path / "7.json").write_text(json.dumps(book))
    b = io.books(spark, str(tmp_path / "7.json"))
    assert [r["text"] for r in io.page_slice(io.pages(b), 7, 2, 2).orderBy("pg").collect()] == ["p2", "p3"]
    assert io.first_text_page(b).first()["first"] == 3 and io.headings(b).first()["title"] == "t"
    (tmp_path / "cat.json").write_text(json.dumps({"books": {str(i): {"id": i, "name": f"b{i}", "cat_id": i % 3, "page_count": i} for i in range(1, 8)}}))
    c = io.catalogue_books(spark, str(tmp_path / "cat.json"))
    assert [r["id"] for r in io.select_books(c, explicit=[5, 2]).orderBy("place").collect()] == [5, 2]
    assert [r["id"] for r in io.select_books(c, priority=[4, 3], categories=[0]).orderBy("place", "id").collect()] == [4, 3, 6]


def test_rebuild_and_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert io.rebuild(spark, path, lambda: spark.range(5)) == 5 and io.rebuild(spark, path, lambda: spark.range(3)) == 3
    with pytest.raises(RuntimeError):
        io.rebuild(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("broken")))
    assert spark.read.parquet(path).count() == 3
    parts = f"file://{tmp_path}/p"
    io.replace_partitions(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), parts, "k")
    io.replace_partitions(spark, spark.createDataFrame([(2, "c")], "k int, v string"), parts, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(parts).collect()} == {(1, "a"), (2, "c")}


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in io.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "k int, t string")
    cache = spark.createDataFrame([("x",)], "t string").select(io.cache_key(F.col("t"), "m", 8).alias("h"), F.array(F.lit(1.0)).alias("v"))
    hits, misses = io.split_by_cache(df.where("t is not null"), cache, "k", "t", "m", 8)
    assert {r["k"] for r in hits.collect()} == {1, 2} and [r["t"] for r in misses.collect()] == ["y"]
    assert tuple(io.cache_counts(df, cache, "t", "m", 8).first()) == (3, 1, 2)


def rows():
    day = dt.datetime(2024, 1, 1)
    hours = [0, 1, 5, 12, 30, 31, 60]
    return [(i, day + dt.timedelta(hours=h), i % 2, "a" if i % 3 else "b", float(i), "{}") for i, h in enumerate(hours)]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame(rows(), events.EVENTS)
    folder = f"file://{tmp_path}/in"
    batch.coalesce(1).write.parquet(folder)
    q = events.tumbling(events.read_stream(spark, folder), "1 day", "10 days").writeStream.format("memory").queryName("tumbling_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling_out").collect())) == sorted(map(tuple, events.tumbling(batch, "1 day").collect()))
    sessions = {(r["user_id"], r["n"]) for r in events.sessions(batch, "6 hours").collect()}
    assert (0, 1) in sessions and sum(n for _, n in sessions) <= 7
    out = f"file://{tmp_path}/out"
    for number in (1, 2):
        events.upsert_batches(events.read_stream(spark, folder), out, f"file://{tmp_path}/ck{number}", "event_id").awaitTermination(120)
        assert spark.read.parquet(out).count() == 7
