"""The stored log and index: batches by stream, replays, compaction, readers between versions."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators import search
from loreweave.streaming import store


def stream(df_dir, schema, spark, fn, checkpoint):
    spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(df_dir).writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(240)


LOG = "doc_id long, seq long, key string, value string"


def newest(df):
    return df.groupBy("doc_id", "key").agg(F.max(F.struct("seq", "value")).alias("s")).select("doc_id", "s.seq", "key", "s.value")


def state(df):
    return sorted((r.doc_id, r.key, r.seq, r.value) for r in newest(df).collect())


def test_log_by_stream_and_compaction(spark, tmp_path):
    rows = [(d, 1000 * d + i, f"k{i % 3}", f"v{i}") for d in range(1, 9) for i in range(4 if d % 2 else 20)]
    for b in range(3):
        spark.createDataFrame(rows[b::3], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/log"
    stream(f"{tmp_path}/in", LOG, spark, lambda df, i: store.append(df, i, path, buckets=4), f"{tmp_path}/c")
    held = store.current(spark, path)
    assert held["batch"] == 2 and state(store.read_log(spark, path)) == state(spark.createDataFrame(rows, LOG))
    store.append(spark.createDataFrame(rows, LOG), 1, path, buckets=4)
    assert store.current(spark, path) == held  # a batch that was there changes nothing
    before, reader = state(store.read_log(spark, path)), store.read_log(spark, path)
    assert store.compact(spark, path, newest, threshold=10, buckets=4) == 4
    assert state(store.read_log(spark, path)) == before == state(reader)  # the old reader still has its parts
    counts = {r.doc_id: r["count"] for r in store.read_log(spark, path).groupBy("doc_id").count().collect()}
    assert counts == {d: 4 if d % 2 else 3 for d in range(1, 9)}
    assert store.compact(spark, path, newest, threshold=10, buckets=4) == 0
    store.vacuum(spark, path)
    assert state(store.read_log(spark, path)) == before
    store.append(spark.createDataFrame([(1, 99999, "k0", "new")], LOG), 3, path, buckets=4)
    assert (1, "k0", 99999, "new") in state(store.read_log(spark, path))


def test_nothing_yet_and_two_writers(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert store.read_log(spark, path) is None and store.compact(spark, path, newest) == 0
    held = store.current(spark, path)
    store.publish(spark, path, held, batch=0)
    with pytest.raises(RuntimeError, match="another writer"):
        store.publish(spark, path, held, batch=0)


DOCS = "doc_id long, seq long, text string, boost double"
BATCHES = [
    [(1, 1, "graph theory", 1.0), (2, 1, "policy gradient methods", 1.0), (3, 1, "theory of graphs", 3.0), (4, 1, "gone soon", 1.0)],
    [(1, 2, "graph theory and practice", 1.0), (2, 2, "policy gradient methods", 1.0), (4, 2, None, 1.0), (5, 1, "policy theory", 1.0), (5, 2, "policy practice", 1.0), (9, 1, None, 1.0)],
    [(4, 3, "graph again", 1.0), (3, 2, None, 3.0), (6, 1, "", 1.0)],
]


def same_index(spark, got, docs):
    fresh = search.postings(docs), search.corpus_stats(docs)
    key = lambda df: sorted(tuple(r[c] for c in ("term", "doc_id", "tf", "dl", "boost")) for r in df.collect())
    assert key(got[0]) == key(fresh[0]) and tuple(got[1].first()) == tuple(fresh[1].first())


def test_index_after_batches_equals_a_fresh_one(spark, tmp_path):
    for b in BATCHES:
        spark.createDataFrame(b, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path, order = f"{tmp_path}/index", []
    # files of one folder come in no fixed order, so the batches are dealt by hand after the first look at the stream
    for i, b in enumerate(BATCHES):
        store.index_batch(spark.createDataFrame(b, DOCS), i, path)
        order.append(store.current(spark, path))
    docs = spark.createDataFrame([(1, "graph theory and practice", 1.0), (2, "policy gradient methods", 1.0), (4, "graph again", 1.0), (5, "policy practice", 1.0), (6, "", 1.0)], "doc_id long, text string, boost double")
    same_index(spark, store.read_index(spark, path), docs)
    store.index_batch(spark.createDataFrame(BATCHES[0], DOCS), 2, path)
    assert store.current(spark, path) == order[-1]
    # an unchanged document has no new version
    assert {r.doc_id: r.version for r in store.documents(spark, path).where("sig is not null").collect()} == {1: 1, 2: 0, 4: 2, 5: 1, 6: 2}
    found = search.search_index(*store.read_index(spark, path), ["graph"]).collect()
    assert {r.doc_id for r in found} == {1, 4}
    store.merge_index(spark, path)
    same_index(spark, store.read_index(spark, path), docs)
    store.vacuum(spark, path)
    store.index_batch(spark.createDataFrame([(2, 9, None, 1.0)], DOCS), 3, path)
    same_index(spark, store.read_index(spark, path), docs.where("doc_id <> 2"))


def test_index_by_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, 1, f"words of {k} and {i}", 1.0) for i in range(4)], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/index"
    stream(f"{tmp_path}/in", DOCS, spark, lambda df, i: store.index_batch(df, i, path), f"{tmp_path}/c")
    assert store.current(spark, path)["batch"] == 2
    same_index(spark, store.read_index(spark, path), spark.read.schema(DOCS).parquet(f"{tmp_path}/in"))


def test_terms_go_into_the_scan(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(i, f"graph w{i} theory{i % 7}", 1.0) for i in range(200)], "doc_id long, text string, boost double")
    path = f"{tmp_path}/index"
    search.write_index(docs, path)
    asked = ["graph theory3", "w19", "nothing here", ""]
    got = search.search_stored(spark, path, asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.bm25_search(docs, asked).collect()))
    got.explain("formatted")
    shown = capsys.readouterr().out
    assert "In(term, [" in shown and "theory3" in shown.split("In(term, [")[1][:400]


def test_a_search_of_more_terms_than_are_pushed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PUSHED", 1)
    docs = spark.createDataFrame([(i, f"graph w{i} theory{i % 7}", 1.0) for i in range(50)], "doc_id long, text string, boost double")
    search.write_index(docs, f"{tmp_path}/index")
    asked = ["graph theory3 w1"]
    assert sorted(map(tuple, search.search_stored(spark, f"{tmp_path}/index", asked).collect())) == sorted(map(tuple, search.bm25_search(docs, asked).collect()))
