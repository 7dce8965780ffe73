import random

import pytest
from review_model import CATEGORIES, box_rows, fold, state_rows

from veilframe.operators.replay import LOG_TYPES, replay_review_log
from veilframe.sources.review_log import review_log
from veilframe.sources.tables import table

from conftest import SF_SMALL

SCHEMA = ", ".join(f"{n} {t}" for n, t in LOG_TYPES.items())
BOX = ["doc_id", "id", "page_index", "x0", "y0", "x1", "y1", "source", "category", "label", "enabled"]
STATE = ["doc_id", "selected_box_id", "focus_count", "undo_left", "redo_left", *[f"{c}_on" for c in CATEGORIES]]


def event(doc_id, seq, op, **fields):
    return {**dict.fromkeys(LOG_TYPES), "doc_id": doc_id, "seq": seq, "op": op, **fields}


def add(doc_id, seq, box_id, op="add_manual", **fields):
    place = {"page_index": 0, "x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 10.0}
    return event(doc_id, seq, op, box_id=box_id, **{**place, **fields})


def run(spark, events, **options):
    log = spark.createDataFrame([tuple(e[n] for n in LOG_TYPES) for e in events], SCHEMA).repartition(4)
    out = replay_review_log(log, **options)
    return out.boxes, out.state


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def check(spark, events, **options):
    boxes, state = run(spark, events, **options)
    expected = fold(events)
    assert rows(boxes, BOX) == sorted(box_rows(expected), key=repr)
    assert rows(state, STATE) == sorted(state_rows(expected), key=repr)


def random_log(rng, doc_id, length, weights, gap):
    ops = list(weights)
    seq, out = 0, []
    for _ in range(length):
        seq += rng.randint(1, gap)
        op = rng.choices(ops, [weights[o] for o in ops])[0]
        box_id = f"b{rng.randint(0, 5)}"
        if op == "select" and rng.random() < 0.2:
            box_id = None
        fields = {"box_id": box_id, "page_index": rng.randint(0, 2)}
        if op in ("add_auto", "rescan_box", "toggle_category"):
            fields["category"] = rng.choice(CATEGORIES[:3])
        if op.startswith("add") or op == "rescan_box" or (op == "update_box" and rng.random() < 0.5):
            x, y = float(rng.randint(0, 50)), float(rng.randint(0, 50))
            fields |= {"x0": x, "y0": y, "x1": x + 5, "y1": y + 5}
        if op in ("add_manual", "update_box"):
            fields["label"] = rng.choice([None, "p", "q"])
        if op == "update_box":
            fields["enabled"] = rng.choice([None, True, False])
        out.append(event(doc_id, seq, op, **fields))
    return out


MIXED = {
    "add_auto": 4, "add_manual": 3, "add_text_select": 2, "toggle_box": 4, "toggle_category": 3,
    "update_box": 4, "delete_box": 2, "select": 4, "focus": 2, "rescan": 1, "rescan_box": 2,
    "undo": 12, "redo": 7, "reset": 0.3,
}


def test_add_toggle_reset_undo_redo(spark):
    events = [add(1, 0, "a"), event(1, 1, "toggle_box", box_id="a")]
    events += [add(2, 0, "a"), event(2, 1, "reset")]
    events += [add(3, 0, "a"), event(3, 1, "undo")]
    events += [add(4, 0, "a"), event(4, 1, "undo"), event(4, 2, "redo")]
    events += [add(5, 0, "a"), add(5, 1, "b"), event(5, 2, "undo"), event(5, 3, "undo")]
    events += [add(6, 0, "a"), add(6, 1, "b")] + [event(6, 2 + i, o) for i, o in enumerate(("undo", "undo", "redo"))]
    events += [add(7, 0, "a"), add(7, 1, "b")]
    events += [event(7, 2 + i, o) for i, o in enumerate(("undo", "undo", "redo", "redo"))]
    boxes, _ = run(spark, events)
    found = {(r["doc_id"], r["id"]): r["enabled"] for r in boxes.collect()}
    assert found == {(1, "a"): False, (4, "a"): True, (6, "a"): True, (7, "a"): True, (7, "b"): True}
    check(spark, events)


def test_quirks(spark):
    auto = {"op": "add_auto", "category": "email"}
    events = [add(1, 0, "a", **auto), event(1, 1, "toggle_category", category="email"), event(1, 2, "undo")]
    # An event that changes nothing still takes an undo step.
    events += [add(2, 0, "a"), event(2, 1, "toggle_box", box_id="nobody"), event(2, 2, "undo")]
    # Only the newest 100 steps can be undone.
    events += [add(3, i, f"a{i}") for i in range(130)] + [event(3, 200 + i, "undo") for i in range(130)]
    boxes, state = run(spark, events)
    by_doc = {r["doc_id"]: r for r in state.collect()}
    assert by_doc[1]["email_on"] is False
    assert boxes.where("doc_id = 1").collect()[0]["enabled"] is True
    assert boxes.where("doc_id = 2").count() == 1
    assert boxes.where("doc_id = 3").count() == 30
    check(spark, events)


def test_focus_counts_and_delete_clears_selection(spark):
    events = [add(1, 0, "a", page_index=2), event(1, 1, "focus", box_id="a"), event(1, 2, "focus", box_id="a")]
    events += [add(2, 0, "a"), event(2, 1, "select", box_id="a"), event(2, 2, "delete_box", box_id="a")]
    _, state = run(spark, events)
    by_doc = {r["doc_id"]: r for r in state.collect()}
    assert (by_doc[1]["selected_box_id"], by_doc[1]["focus_count"]) == ("a", 2)
    assert by_doc[2]["selected_box_id"] is None
    check(spark, events)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_one_event_at_a_time(spark, seed):
    rng = random.Random(seed)
    events = [e for d in range(40) for e in random_log(rng, d, rng.randint(1, 80), MIXED, 3)]
    check(spark, events)


@pytest.mark.parametrize("chunk,fan_in", [(4, 3), (16, 4), (64, 1000)])
def test_long_logs_are_cut_into_chunks(spark, chunk, fan_in):
    rng = random.Random(chunk)
    calm = {**MIXED, "reset": 0, "undo": 10, "redo": 8}
    runs = {**MIXED, "reset": 0, "undo": 3, "redo": 2}
    events = random_log(rng, 1, 900, calm, 2) + random_log(rng, 2, 900, runs, 1) + random_log(rng, 3, 30, MIXED, 40)
    check(spark, events, chunk_events=chunk, fan_in=fan_in)


def test_generated_log(spark):
    log = review_log(table(spark, SF_SMALL, "events"))
    out = replay_review_log(log)
    expected = fold([r.asDict() for r in log.collect()])
    assert rows(out.boxes, BOX) == sorted(box_rows(expected), key=repr)
    assert rows(out.state, STATE) == sorted(state_rows(expected), key=repr)
