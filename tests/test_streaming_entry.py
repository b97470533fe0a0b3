import json
import os
import tempfile

from recsift.streaming import stateless as ss


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="recsift-stream-")
    rows = [{"user_id": f"u{i}", "parent_asin": "a", "rating": "5", "timestamp": str(100 * i),
             "title": "t" if i % 2 else None, "text": "x" * (20 + i)} for i in range(30)]
    for n in range(3):
        with open(os.path.join(src, f"f{n}.json"), "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in rows[n * 10:(n + 1) * 10]) + "\n")
    stream = ss.clean_and_route(ss.review_stream(spark, src, 1), 1000, 2000)
    q = stream.writeStream.format("memory").queryName("recsift_stream_test").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.user_id, r.split) for r in spark.sql("SELECT * FROM recsift_stream_test").collect())
    expect = sorted((r["user_id"], "test" if 100 * i >= 2000 else "valid" if 100 * i >= 1000 else "train")
                    for i, r in enumerate(rows) if len((("t " if i % 2 else "") + r["text"])) > 30)
    assert got == expect


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"user_id", "parent_asin", "rating", "timestamp", "seq", "split", "history"}
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_stream_to_parquet_table(spark):
    src = tempfile.mkdtemp(prefix="recsift-stream-src-")
    out = tempfile.mkdtemp(prefix="recsift-stream-out-")
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write(json.dumps({"user_id": "u", "parent_asin": "a", "rating": "5", "timestamp": "5",
                             "title": None, "text": "y" * 40}) + "\n")
        fh.write(json.dumps({"user_id": "v", "parent_asin": "b", "rating": "x", "timestamp": "6",
                             "title": None, "text": "z" * 40}) + "\n")
    q = ss.start_to_table(ss.clean_and_route(ss.review_stream(spark, src), 1, 10), os.path.join(out, "ckpt"),
                          os.path.join(out, "table"))
    q.awaitTermination(120)
    got = [(r.user_id, r.split) for r in spark.read.parquet(os.path.join(out, "table")).collect()]
    assert got == [("u", "valid")]
