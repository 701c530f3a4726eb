from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.chunking import explode_chunks
from corpusflow.operators.windows import session_window
from corpusflow.plans.workloads import QUERIES
from corpusflow.streaming import ingest
from corpusflow.streaming.ingest import read_ingested, read_newest, run_available, stored_chunks, stream_ingest, write_batches
from corpusflow.streaming.latest import stream_latest
from corpusflow.streaming.sessions import newest_per_frame, stream_session


@pytest.fixture
def feed(spark, tmp_path):
    """Write one micro-batch of rows, then the stream over all of them."""

    class Feed:
        def __init__(self, schema):
            self.schema, self.path = schema, str(tmp_path / "in")

        def add(self, *rows):
            spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
            return self

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

        def batch(self):
            return spark.read.schema(self.schema).parquet(self.path)

    return Feed


def test_ingest_replaces_shrunk_documents_and_resumes(spark, feed, tmp_path):
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    docs = feed("path string, text string, seen int").add(("a", "x " * 600, 1), ("b", "bb", 1)).add(("a", "short", 2))
    stream_ingest(docs.stream(), root, checkpoint)
    stored = lambda: sorted((r.id, r.content) for r in stored_chunks(read_ingested(spark, root)).select("id", "content").collect())
    assert stored() == [("a::0", "short"), ("b::0", "bb")]
    stream_ingest(docs.stream(), root, checkpoint)
    assert stored() == [("a::0", "short"), ("b::0", "bb")]
    docs.add(("c", "new one", 3), ("c", "older", 2))
    stream_ingest(docs.stream(), root, checkpoint)
    assert stored() == [("a::0", "short"), ("b::0", "bb"), ("c::0", "new one")]


def test_ingest_equals_batch(spark, feed, tmp_path, folder):
    root = str(tmp_path / "out")
    source = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text", F.lit(1).alias("seen"))
    docs = feed("path string, text string, seen int")
    source.repartition(3).write.parquet(docs.path)
    stream_ingest(docs.stream(), root, str(tmp_path / "checkpoint"))
    batch = explode_chunks(source.select("path", "text"), "path", "text").select("id", "content")
    streamed = stored_chunks(read_ingested(spark, root)).select("id", "content")
    assert batch.exceptAll(streamed).isEmpty() and streamed.exceptAll(batch).isEmpty()


def test_a_batch_writes_its_own_rows_only(spark, feed, tmp_path):
    root = tmp_path / "out"
    docs = feed("path string, text string, seen int").add(*[(f"p{i}", "t " * 400, 1) for i in range(30)]).add(("p3", "new", 2), ("q", "qq", 2))
    stream_ingest(docs.stream(), str(root), str(tmp_path / "checkpoint"))
    parts = {p.name: sorted(x for x in p.rglob("*.parquet")) for p in root.iterdir() if "=" in p.name}
    rows = {name: spark.read.parquet(str(root / name)).count() for name in parts}
    assert sorted(rows.values()) == [2, 30]
    # the second batch again: its partition is replaced, the other one's files stay, nothing is counted twice
    second = min(rows, key=rows.get)
    again = spark.createDataFrame([("p3", "new", 2), ("q", "qq", 2)], "path string, text string, seen int")
    before = read_ingested(spark, str(root)).orderBy("path").collect()
    ingest.ingest_batches(str(root))(again, int(second.split("=")[1]))
    after = {p.name: sorted(x for x in p.rglob("*.parquet")) for p in root.iterdir() if "=" in p.name}
    assert {n: f for n, f in after.items() if n != second} == {n: f for n, f in parts.items() if n != second}
    assert read_ingested(spark, str(root)).orderBy("path").collect() == before and len(before) == 31
    # an older version that comes later does not replace a newer one
    ingest.ingest_batches(str(root))(spark.createDataFrame([("q", "older", 1)], "path string, text string, seen int"), 99)
    assert [r.content for r in stored_chunks(read_ingested(spark, str(root))).where("path = 'q'").collect()] == ["qq"]


TIME = datetime(2024, 1, 1)


def test_session_memory_equals_batch(spark, feed, tmp_path):
    message = lambda c, t: (c, t, ("user", "assistant")[t % 2], f"m{t}", TIME + timedelta(minutes=t))
    messages = (
        feed("conv_id long, turn long, role string, text string, ts timestamp")
        .add(*[message(1, t) for t in range(0, 18)], (1, 90, "system", "s", TIME), message(2, 0))
        .add(*[message(1, t) for t in range(20, 30)])
        .add(message(1, 18), message(1, 19), message(1, 29), message(3, 4))
    )
    root = str(tmp_path / "out")
    updates = stream_session(messages.stream())
    run_available(updates, write_batches(root), str(tmp_path / "checkpoint"), "update")
    expected = session_window(messages.batch().distinct())
    plain = lambda df: sorted((r.conv_id, [tuple(m) for m in r.messages]) for r in df.collect())
    assert plain(read_newest(spark, root, ["conv_id"])) == plain(expected)


def test_idle_conversations_end(spark, feed, tmp_path):
    at = lambda hours: TIME + timedelta(hours=hours)
    messages = feed("conv_id long, turn long, role string, text string, ts timestamp")
    for hour, conv in enumerate((1, 2, 3, 4, 5, 6)):
        messages.add((conv, hour, "user", f"m{hour}", at(10 * hour)))
    messages.add((1, 6, "user", "back", at(60)), (6, 7, "user", "still here", at(60)))
    root = str(tmp_path / "out")
    query = run_available(stream_session(messages.stream(), idle_ms=15 * 3600 * 1000), write_batches(root), str(tmp_path / "checkpoint"), "update")
    found = {r.conv_id: [m.text for m in r.messages] for r in read_newest(spark, root, ["conv_id"]).collect()}
    # conversation 1 ended and began anew; 6 was not idle for long
    assert found[1] == ["back"] and found[6] == ["m5", "still here"] and found[3] == ["m2"]
    held = [p["stateOperators"][0]["customMetrics"]["numDeletedKeys"] if "numDeletedKeys" in p["stateOperators"][0]["customMetrics"] else p["stateOperators"][0]["numRowsRemoved"]
            for p in query.recentProgress if p["stateOperators"]]
    assert sum(held) > 0


def test_frames_are_cut_one_by_one():
    frames = [pd.DataFrame({"conv_id": [1] * 50 + [2], "turn": [*range(50), i]}) for i in range(20)]
    cut = newest_per_frame(4)(iter(frames))
    assert all(len(frame) == 5 and sorted(frame["turn"])[-4:] == [46, 47, 48, 49] for frame in cut)


def test_late_events_do_not_overwrite(spark, feed, tmp_path):
    at = lambda hour: datetime(2024, 1, 1, hour)
    events = (
        feed("k string, ts timestamp, event_id long, v string")
        .add(("a", at(5), 5, "five"), ("b", at(1), 1, "one"))
        .add(("a", at(3), 3, "three"), ("b", at(2), 2, "two"), ("a", at(5), 5, "five"))
        .add(("a", at(5), 6, "six"))
    )
    root = str(tmp_path / "out")
    updates = stream_latest(events.stream(), ["k"], ["ts", "event_id"], "v", delay="6 hours")
    run_available(updates, write_batches(root), str(tmp_path / "checkpoint"), "update")
    assert sorted((r.k, r.v) for r in read_newest(spark, root, ["k"], ["_order"]).collect()) == [("a", "six"), ("b", "two")]


def test_late_rows_count_within_the_delay_and_state_ends(spark, feed, tmp_path):
    at = lambda hour: TIME + timedelta(hours=hour)
    events = feed("k string, ts timestamp, event_id long, v string")
    for day in range(6):
        events.add(*[(f"k{day}-{i}", at(24 * day), 100 * day + i, "on time") for i in range(20)])
    # the watermark is day 5 less six hours when these come: the first is late within it, the second beyond; the third is a repeat
    events.add(("late", at(24 * 5 - 5), 901, "counts"), ("late", at(24), 902, "dropped"), ("k5-0", at(24 * 5), 500, "a repeat"))
    events.add(("end", at(24 * 30), 999, "end")).add(("end", at(24 * 31), 1000, "end"))
    root = str(tmp_path / "out")
    updates = stream_latest(events.stream(), ["k"], ["ts", "event_id"], "v", delay="6 hours", span="1 day")
    query = run_available(updates, write_batches(root), str(tmp_path / "checkpoint"), "update")
    found = {r.k: r.v for r in read_newest(spark, root, ["k"], ["_order"]).collect()}
    assert found["late"] == "counts" and found["k5-0"] == "on time" and len(found) == 122
    rows = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) <= 130 and rows[-1] <= 4  # 122 keys and 123 ids came; only those of open spans are held


@pytest.mark.parametrize("name", ["stream_chunk_counts", "stream_ingest", "stream_session"])
def test_tables_in_several_files_are_streamed_whole(spark, tmp_path, name):
    """A large table is a folder of files, whose names are not the table's."""
    documents = [(i, f"text {i} " * i, "s") for i in range(40)]
    messages = [(c, t, ("user", "assistant")[t % 2], f"m{c} {t}") for c in range(5) for t in range(6)]
    for kind, files in (("one", 1), ("many", 4)):
        spark.createDataFrame(documents, "doc_id long, text string, source string").repartition(files).write.parquet(str(tmp_path / kind / "documents.parquet"))
        spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").repartition(files).write.parquet(str(tmp_path / kind / "conversations.parquet"))
    single = tmp_path / "single"
    single.mkdir()
    for table in ("documents", "conversations"):
        (part,) = (tmp_path / "one" / f"{table}.parquet").glob("*.parquet")
        (single / f"{table}.parquet").write_bytes(part.read_bytes())
    found = [sorted(map(str, QUERIES[name](spark, str(at)).collect())) for at in (single, tmp_path / "many")]
    assert found[0] == found[1] and len(found[0]) == {"stream_chunk_counts": 1, "stream_ingest": 40, "stream_session": 5}[name]
