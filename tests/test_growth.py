"""Steps whose memory, shuffles or time must not outgrow the input."""

import os
import re
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import suite
from helpers import rows, small
from tidemark.operators import asof, docs, ml, text, text_index, tiles
from tidemark.operators.aggregate import Aggregation
from tidemark.plans import documents
from tidemark.plans.documents import DocumentTable
from tidemark.session import reliable
from tidemark.sources import buckets
from tidemark.sources.buckets import BucketTable
from tidemark.streaming import state

suite.load_all()


def test_document_files_are_bounded(spark, tmp_path, monkeypatch):
    """More text is more files, not longer ones: a file is one row."""
    table = spark.range(48).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd efg "), 120_000).alias("text"))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    sizes, read = [], suite.documents.read_documents

    def spy(session, place):
        sizes.extend(os.path.getsize(os.path.join(place, f)) for f in os.listdir(place) if f.endswith(".txt"))
        return read(session, place)

    monkeypatch.setattr(suite.documents, "read_documents", spy)
    found = suite.QUERIES["document_files"](spark, str(tmp_path)).first()
    assert found["size"] == 48 * (9 * 120_000 + 1) and found["named"]
    assert max(sizes) <= 1.5 * suite.documents.FILE_BYTES


def test_chunks_leave_in_bounded_batches(spark):
    """One batch of long texts gives many batches of chunks, with the values of their rows."""
    texts = ["word and more. " * 100_000, None, "", "short"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts)], names=["k", "t"])
    schema = pa.schema([("k", pa.int64()), ("pos", pa.int32()), ("text", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
    out = list(docs._pieces(iter([batch]), lambda t: docs.chunk_spans(t, 1000, 200), schema))
    assert max(sum(map(len, b.column(2).to_pylist())) for b in out) <= docs.BATCH_CHARS + 1000
    found = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(i, n, t[a:b].strip(), a, b) for i, t in enumerate(texts) for n, (a, b) in enumerate(docs.chunk_spans(t or "", 1000, 200))]
    assert found == want

    df = small(spark, [(1, "x", "one two. three"), (2, None, None)], "id long, tag string, text string")
    want = [(1, "x", n, "one two. three"[a:b].strip(), a, b) for n, (a, b) in enumerate(docs.chunk_spans("one two. three", 10, 2))]
    assert rows(docs.chunk(df, "text", 10, 2)) == want


def test_binned_training_keeps_every_row(spark, monkeypatch):
    """Above the bound rows of the same bins become weighted ones; the model is as good and reads raw features."""
    table = spark.range(6000).select(
        (F.xxhash64("id") % 1000 / 10.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000 / 10.0).alias("b")
    ).withColumn("y", (F.col("a") + F.col("b") > 20).cast("int"))
    table = reliable(table)
    monkeypatch.setattr(ml, "MOST_ROWS", 1500)
    seen = []
    inner = ml._binned

    def spy(*args, **how):
        out = inner(*args, **how)
        seen.append((args[0].agg(F.sum("_weight")).first()[0], *out.agg(F.sum("_weight"), F.count("*")).first()))
        return out

    monkeypatch.setattr(ml, "_binned", spy)
    for kind, settings in (("boosted", {"maxIter": 5}), ("forest", {"numTrees": 20})):
        out = ml.predict(ml.train(table, ["a", "b"], "y", kind, **settings), table)
        assert ml.evaluate(out, "probability", "prediction", "y").first()["roc_auc"] > 0.95
    for whole, weight, instances in seen:
        assert abs(whole - weight) < 1e-6 * whole and instances < 6000
    assert len(seen) == 2


def test_grids_are_dealt_by_their_rows(spark, monkeypatch):
    """Few tiles that fill a long grid are many tasks."""
    monkeypatch.setattr(tiles, "GRID_ROWS", 1000)
    start = datetime(2024, 1, 1)
    data = [(k, start + timedelta(hours=h), float(k + h)) for k in range(40) for h in (k % 5, 300)]
    df = small(spark, data, "k long, ts timestamp_ntz, v double")
    specs = [Aggregation("v", "sum", timedelta(hours=24))]
    whole = {}
    for dense in (True, "span"):
        out = tiles.aggregate_tiled(df, ["k"], specs, "ts", timedelta(hours=1), dense)
        assert out.rdd.getNumPartitions() >= (12 if dense is True else 2)
        whole[dense] = rows(out)
    assert len(whole[True]) == 40 * 301
    filled = {r[:2]: r[2] for r in whole[True]}
    assert all(filled[r[:2]] == r[2] for r in whole["span"])


def test_joined_search_shuffles_no_pairs(spark):
    """Scores of a row are summed where it lies; only k per query and task travel."""
    docs_ = small(spark, [(i, f"red {'blue' if i % 2 else 'green'} w{i}") for i in range(200)], "d long, t string")
    asked = small(spark, [(1, "red blue"), (2, "green w7")], "q long, t string")
    found = text.bm25(docs_, "d", ["t"], asked, "q", "t", 3, "any", matrix_bytes=0)
    assert rows(found) == rows(text.bm25(docs_, "d", ["t"], asked, "q", "t", 3, "any"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(q#\d+L?, d#", plan)


def test_interval_lookups_do_not_walk_histories(spark):
    """A broadcast side with long histories is looked up by key and time cell."""
    start = datetime(2024, 1, 1)
    side = small(spark, [(k, start + timedelta(hours=h), k * 1000 + h) for k in range(3) for h in range(0, 400, 2)], "k long, ts timestamp_ntz, v long")
    data = [(i, i % 4, start + timedelta(minutes=37 * i - 100)) for i in range(700)] + [(701, None, start), (702, 1, None)]
    entity = small(spark, data, "i long, k long, at timestamp_ntz")
    how = asof.Side(side, ("k",), "ts", {"v": "v"}, ttl=timedelta(hours=300))
    found = asof.asof_join(entity, how, "at", "broadcast")
    assert rows(found) == rows(asof.asof_join(entity, how, "at", "window"))
    assert "_cell" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_key_closes_its_windows_in_one_call(spark, tmp_path):
    """Windows of a key that close together are one call; the values are those of tiles."""
    ring = state.Ring(["k"], "ts", ["v"], [("sum", 0, "s", 3), ("std", 0, "d", 2)], 3_600_000_000)
    calls = {"set": [], "gone": []}

    class Handle:
        def getValueState(self, name, schema):
            class Value:
                kept = None

                def exists(self):
                    return self.kept is not None

                def get(self):
                    return self.kept

                def update(self, value):
                    self.kept = value

                def clear(self):
                    self.kept = None

            return Value()

        def registerTimer(self, at):
            calls["set"].append(at)

        def deleteTimer(self, at):
            calls["gone"].append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 6 * 3_600_000

        def getExpiryTimeInMs(self):
            return calls["set"][-1]

    ring.init(Handle())
    hours = [5, 1, 2, 2, 8]
    ring.handleInputRows((7,), iter([pd.DataFrame({"ts": pd.to_datetime([h * 3_600_000 + 5 for h in hours], unit="ms"), "v": [1.0, 2.0, 3.0, 5.0, 9.0]})]), None)
    assert calls["set"] == [2 * 3_600_000]
    (out,) = ring.handleExpiredTimer((7,), Times(), Times())
    # the hop that ends at the watermark itself is still open
    assert out["s"].tolist() == [2.0, 10.0] and out["d"].tolist()[0] is None and len(out) == 2
    assert calls["set"] == [2 * 3_600_000, 6 * 3_600_000] and not calls["gone"]


def test_stored_postings_are_made_once_and_not_paired_with_queries(spark, tmp_path, monkeypatch):
    """A document's words are read once for its blocks, its id stands once in a range, and a search explodes no postings."""
    monkeypatch.setattr(text_index, "spread_small", lambda df: df)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.range(500).select("id", F.concat_ws(" ", F.lit("all"), F.col("id") % 7, F.col("id") % 40).alias("text"))
    index = text_index.TextIndex(str(tmp_path / "i"), "id", buckets=4, range_docs=50)
    index.add(table.mapInArrow(count, "id long, text string"), ["text"])
    assert read.value == 500

    stored = index._read(spark, index._pointer(spark).read()[1]["folders"])
    held = stored.agg(F.sum(F.when(F.col("ids").isNotNull(), F.size("ids"))), F.sum(F.when(F.col("term").isNotNull(), F.size("place")))).first()
    assert held[0] == 500 and held[1] > 1000

    plans, top = [], text_index.top_rows

    def spy(df, *args):
        plans.append(df._jdf.queryExecution().toString())
        return top(df, *args)

    monkeypatch.setattr(text_index, "top_rows", spy)
    asked = small(spark, [(q, f"all {q} {q + 7}") for q in range(7)], "q long, ask string")
    found = index.bm25(asked, "q", "ask", 3, "any")
    want = text.bm25(table, "id", ["text"], asked, "q", "ask", 3, "any")
    assert rows(found, "q", "id", "rank", "distance") == rows(want, "q", "id", "rank", "distance")
    assert plans and not any("arrays_zip" in p for p in plans)


def test_a_range_is_scored_for_slices_of_queries(spark, tmp_path, monkeypatch):
    """More queries than a range is scored for at a time give the same answers, ties and repeated ids included."""
    monkeypatch.setattr(text_index, "GROUP_QUERIES", 2)
    monkeypatch.setattr(text_index, "BROADCAST_PAIRS", 0)
    data = [(f"d{k % 30}", " ".join(["a"] * (k % 3) + [f"w{k % 5}", "é" if k % 2 else "x"])) for k in range(80)] + [("d1", None)]
    table = small(spark, data, "doc string, text string")
    asked = small(spark, [(q, f"a w{q} e") for q in range(5)] + [(5, "x"), (6, "nothing")], "q int, ask string")
    index = text_index.TextIndex(str(tmp_path / "i"), "doc", buckets=3, range_docs=7)
    index.add(table, ["text"])
    for match in ("any", "all"):
        want = text.bm25(table, "doc", ["text"], asked, "q", "ask", 4, match)
        assert rows(index.bm25(asked, "q", "ask", 4, match), "q", "doc", "distance") == rows(want, "q", "doc", "distance")


def test_bucket_rows_are_not_read_for_a_sample(spark, tmp_path, monkeypatch):
    """Rows that go into buckets are read for their keys and to be written, and once more for the keys if rows were there."""
    monkeypatch.setattr(buckets, "ONE_FILE_BYTES", 0, raising=False)
    monkeypatch.setattr(buckets, "fits_one_task", lambda *dfs: False, raising=False)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = BucketTable(str(tmp_path / "t"), ("k",), "k long, v long", 4)
    first = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table.replace(first.limit(0).select("k"), first.mapInArrow(count, "k long, v long"))
    assert read.value == 600
    assert rows(table.read_keys(spark.range(3).select(F.col("id").alias("k")))) == [(0, 0), (1, 2), (2, 4)]
    monkeypatch.setattr(buckets, "BROADCAST_KEYS", 0, raising=False)
    table.replace(first.where("k < 10").select("k"), first.where("k < 5").withColumn("v", F.lit(-1)))
    assert rows(table.read(spark).where("k < 12")) == rows(small(spark, [(k, -1) for k in range(5)] + [(10, 20), (11, 22)], "k long, v long"))


def test_texts_of_documents_stay_where_they_lie(spark, tmp_path, monkeypatch):
    """Changed texts are chunked without a shuffle of texts, unless ids repeat."""
    plans, whole = [], documents.chunk

    def spy(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, *args, **kw)

    monkeypatch.setattr(documents, "chunk", spy)
    data = spark.range(60).select("id", F.concat(F.lit("One two. "), F.col("id") % 50).alias("t"))
    data.write.parquet(str(tmp_path / "d"))
    data = spark.read.parquet(str(tmp_path / "d"))
    table = DocumentTable(str(tmp_path / "t"), "id", "long", 40, 10, buckets=4)
    assert table.update(data, "t")["changed"] == 60
    done = table.update(data.where("id <> 7").withColumn("t", F.when(F.col("id") < 20, F.concat("t", F.lit("!"))).otherwise(F.col("t"))), "t")
    assert (done["changed"], done["removed"]) == (19, 1)
    assert not any("hashpartitioning" in p for p in plans) and "BroadcastHashJoin" in plans[1]
    twice = small(spark, [(1, "a"), (1, "b"), (1, "b"), (2, None)], "id long, t string")
    table.update(twice, "t")
    greatest = max(("a", "b"), key=lambda x: __import__("hashlib").sha256(x.encode()).hexdigest())
    assert rows(table.read(spark), "id", "pos", "text") == [(1, 0, greatest)]
