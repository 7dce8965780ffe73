import random

from conftest import SF_SMALL
from review_model import box_rows, fold, state_rows
from test_replay import BOX, MIXED, SCHEMA, STATE, add, event, random_log, rows

from veilframe.operators.replay import LOG_TYPES, replay_review_log
from veilframe.operators import replay
from veilframe.operators.review_store import append_events, states_of
from veilframe.plans import inputs
from veilframe.sources.batches import current, merge_due, put_batch, batch_tables, whole
from veilframe.sources.tables import table
from veilframe.streaming.detect import read_latest_scans, stream_detect, stream_latest_scans, stream_table
from veilframe.streaming.replay import read_review, read_review_boxes, stream_review_replay


def write_in_order(spark, folder, parts):
    for part in parts:
        data = [tuple(e[n] for n in LOG_TYPES) for e in part]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, parts):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    write_in_order(spark, folder, parts)
    log = stream_table(spark, folder, spark.read.parquet(folder).schema, max_files=1)
    stream_review_replay(log, out, str(tmp_path / "marks")).awaitTermination()
    return out


def test_review_over_micro_batches(spark, tmp_path):
    rng = random.Random(3)
    logs = [random_log(rng, d, 90, {**MIXED, "reset": 0.5}, 2) for d in range(12)]
    parts = [[e for log in logs for e in log[i * 30 : i * 30 + 30]] for i in range(3)]
    for part in parts:
        rng.shuffle(part)
    out = run(spark, tmp_path, parts)
    expected = fold([e for log in logs for e in log])
    assert rows(read_review_boxes(spark, out), BOX) == sorted(box_rows(expected), key=repr)
    assert len(states_of(spark, out).select("batch_id").distinct().collect()) == 3


def test_late_events_are_not_lost(spark, tmp_path):
    parts = [[add(1, 5, "a"), add(1, 6, "b"), add(2, 1, "c")], [event(1, 4, "toggle_box", box_id="a"), event(1, 7, "delete_box", box_id="b")]]
    parts += [[event(1, 3, "focus", box_id="b")]]
    out = run(spark, tmp_path, parts)
    review = read_review(spark, out)
    expected = fold([e for p in parts for e in p])
    assert rows(review.boxes, BOX) == sorted(box_rows(expected), key=repr)
    assert rows(review.state, STATE) == sorted(state_rows(expected), key=repr)
    # A micro-batch of late events alone is told, too.
    last = states_of(spark, out).where("batch_id = 2").collect()
    assert [(r.doc_id, r.late) for r in last] == [(1, 2)]


def test_hot_document_is_cut_into_chunks(spark, tmp_path):
    """A document with all events of a file, in chunks of 16 over many tasks, and steps that reach back to earlier files."""
    rng = random.Random(8)
    logs = [random_log(rng, 1, 700, {**MIXED, "reset": 0.3}, 2), random_log(rng, 2, 40, MIXED, 1)]
    events = [e for log in logs for e in log]
    parts = [[e for e in events if low <= e["seq"] < high] for low, high in ((0, 250), (250, 251), (251, 10_000))]
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in parts:
        rng.shuffle(part)
    write_in_order(spark, folder, parts)
    log = stream_table(spark, folder, spark.read.parquet(folder).schema, max_files=1)
    stream_review_replay(log, out, str(tmp_path / "marks"), chunk_events=16, fan_in=4).awaitTermination()
    review = read_review(spark, out)
    expected = fold(events)
    assert rows(review.boxes, BOX) == sorted(box_rows(expected), key=repr)
    assert rows(review.state, STATE) == sorted(state_rows(expected), key=repr)


def test_no_task_gets_more_than_a_chunk(spark, tmp_path):
    """Of one document's events in one file, what a task walks in one go is a chunk."""
    rng = random.Random(9)
    events = [e for e in random_log(rng, 1, 400, MIXED, 2) if e["op"] != "reset"]
    log = spark.createDataFrame([tuple(e[n] for n in LOG_TYPES) for e in events], SCHEMA)
    done = replay.walked(log, replay.DISPLAY_ORDER, 16, 4)
    per_chunk = done.groupBy("doc_id", "chunk").count().collect()
    assert len(per_chunk) > 20 and max(r["count"] for r in per_chunk) <= 16


def test_appended_log(spark, tmp_path):
    """New events don't make the earlier ones be walked again, and an append may be repeated."""
    rng = random.Random(10)
    logs = [random_log(rng, d, 120, {**MIXED, "reset": 0.5}, 2) for d in range(5)]
    events = [e for log in logs for e in log]
    store = str(tmp_path / "store")
    for batch, (low, high) in enumerate(((0, 80), (80, 100), (100, 10_000))):
        part = [tuple(e[n] for n in LOG_TYPES) for e in events if low <= e["seq"] < high]
        for _ in range(2 if batch == 1 else 1):
            append_events(spark.createDataFrame(part, SCHEMA), store, batch)
        kept = spark.read.parquet(f"{store}/batch_id={batch}/part=events")
        assert kept.count() <= len(part) and kept.agg({"seq": "min"}).first()[0] >= low
    review, expected = read_review(spark, store), fold(events)
    assert rows(review.boxes, BOX) == sorted(box_rows(expected), key=repr)
    assert rows(review.state, STATE) == sorted(state_rows(expected), key=repr)


def test_nothing_appended(spark, tmp_path):
    store = str(tmp_path / "store")
    assert read_review(spark, store).boxes.count() == 0
    append_events(spark.createDataFrame([], SCHEMA), store, 0)
    assert read_review(spark, store).state.count() == 0


def test_categories_without_a_policy(spark, tmp_path):
    auto = {"op": "add_auto", "category": "orderNo"}
    events = [add(1, 0, "a", **auto), event(1, 1, "toggle_box", box_id="a"), event(1, 2, "toggle_category", category="orderNo")]
    streamed = read_review(spark, run(spark, tmp_path, [events]))
    batch = replay_review_log(spark.createDataFrame([tuple(e[n] for n in LOG_TYPES) for e in events], SCHEMA))
    assert rows(streamed.boxes, BOX) == rows(batch.boxes, BOX) and rows(streamed.state, STATE) == rows(batch.state, STATE)


def test_detection_picks_up_where_it_stopped(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    pages = inputs.document_pages(spark, SF_SMALL)
    schema = pages.schema
    for low, high in ((0, 100), (100, 200)):
        pages.where(f"doc_id >= {low} AND doc_id < {high}").write.mode("append").parquet(source)
        stream_detect(stream_table(spark, source, schema), out, marks).awaitTermination()
    from veilframe.operators.detect import detect_pages

    batch = detect_pages(pages)
    assert rows(spark.read.parquet(out), batch.columns) == rows(batch, batch.columns)
    assert table(spark, SF_SMALL, "documents").count() == 200


def test_latest_scan_over_micro_batches(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "doc_id bigint, page_index int, scan_seq bigint, category string"
    parts = [
        [(1, 0, 2, "new"), (1, 0, 2, None), (2, 0, 1, "only"), (3, 0, 1, "gone")],
        [(1, 0, 1, "old"), (1, 0, 1, None), (1, 1, 3, "other page")],
        # The newest scan of document 3 found nothing.
        [(2, 0, 4, "x"), (2, 0, 4, "y"), (3, 0, 5, None)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    arriving = stream_table(spark, source, spark.read.parquet(source).schema, max_files=1)
    stream_latest_scans(arriving, out, marks).awaitTermination()
    got = sorted((r.doc_id, r.page_index, r.category) for r in read_latest_scans(spark, out).collect())
    assert got == [(1, 0, "new"), (1, 1, "other page"), (2, 0, "x"), (2, 0, "y")]


def test_fifty_micro_batches_are_few_folders(spark, tmp_path):
    """Scans in any order over 50 micro-batches, merged by fours: the newest of each page, and what they replace is gone."""
    rng = random.Random(4)
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "doc_id bigint, page_index int, scan_seq bigint, category string"
    events = [(rng.randrange(6), 0, seq) for seq in range(200)]
    rng.shuffle(events)
    found = {e: [f"{e[2]}{c}" for c in "ab"[: rng.randrange(3)]] for e in events}
    for k in range(50):
        part = [(*e, c) for e in events[4 * k : 4 * k + 4] for c in (None, *found[e])]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    arriving = stream_table(spark, source, spark.read.parquet(source).schema, max_files=1)
    stream_latest_scans(arriving, out, marks, fan=4).awaitTermination()
    newest = {d: max(e for e in events if e[0] == d) for d, _, _ in events}
    got = sorted((r.doc_id, r.scan_seq, r.category) for r in read_latest_scans(spark, out).collect())
    assert got == sorted((e[0], e[2], c) for e in newest.values() for c in found[e])
    assert [b - a + 1 for a, b in current(spark, out, "results")] == [16, 16, 16, 1, 1]
    # What the last merge replaced is still there, for readers that listed it; nothing older is.
    left = set(whole(spark, out, "results")) - set(current(spark, out, "results"))
    assert left == {(32, 35), (36, 39), (40, 43), *((k, k) for k in range(44, 48))}
    merged = batch_tables(spark, out, [(0, 15)], ["scans"])["scans"]
    assert merged.count() == len({e[0] for e in events[:64]})


def test_merges_can_be_cut_short_and_repeated(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    union = lambda tables: tables
    read = lambda: sorted(r.v for r in batch_tables(spark, store, current(spark, store, "b"), ["b"])["b"].collect())
    for k in range(4):
        put_batch(store, k, k, {"a": rows(k), "b": rows(10 + k)})
        if k == 1:
            # A merge that stopped after its first table isn't seen.
            rows(0, 1).write.parquet(f"{store}/first=0/last=1/part=a")
            assert current(spark, store, "b") == [(0, 0), (1, 1)] and read() == [10, 11]
        for _ in range(2):  # a micro-batch that is run again
            merge_due(spark, store, k, ["a", "b"], union, 2)
    assert current(spark, store, "b") == [(0, 3)] and read() == [10, 11, 12, 13]
    put_batch(store, 3, 3, {"a": rows(3), "b": rows(13)})
    assert current(spark, store, "b") == [(0, 3)] and read() == [10, 11, 12, 13]
    put_batch(store, 4, 4, {"a": rows(), "b": rows()})
    assert current(spark, store, "b") == [(0, 3), (4, 4)] and read() == [10, 11, 12, 13]
