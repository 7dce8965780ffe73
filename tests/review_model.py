"""A plain snapshot model of the review state, one event at a time. Only tests use it."""

import copy

CATEGORIES = ("rrn", "phone", "email", "account", "businessNo", "card", "address")
SOURCES = {"add_auto": "auto", "add_manual": "manual-rect", "add_text_select": "text-select"}


class Review:
    def __init__(self):
        self.clear()

    def clear(self):
        self.boxes, self.selected, self.focus_count = {}, None, 0
        self.policy = dict.fromkeys(CATEGORIES, True)
        self.past, self.future = [], []

    def snapshot(self):
        return copy.deepcopy((self.boxes, self.selected))

    def push(self):
        self.past.append(self.snapshot())
        self.past = self.past[-100:]
        self.future = []

    def new_box(self, e, source, enabled):
        self.boxes[e["box_id"]] = {
            "page_index": e["page_index"],
            "xy": (e["x0"], e["y0"], e["x1"], e["y1"]),
            "source": source,
            "category": e["category"] if source == "auto" else None,
            "label": e["label"] if source == "manual-rect" else None,
            "enabled": enabled,
        }

    def apply(self, e):
        op, box_id = e["op"], e["box_id"]
        if op == "reset":
            self.clear()
        elif op == "undo":
            if self.past:
                self.future.append(self.snapshot())
                self.boxes, self.selected = self.past.pop()
        elif op == "redo":
            if self.future:
                self.past.append(self.snapshot())
                self.boxes, self.selected = self.future.pop()
        elif op == "select":
            self.selected = box_id
        elif op == "focus":
            self.selected = box_id
            self.focus_count += 1
        elif op == "rescan":
            self.boxes = {
                k: b for k, b in self.boxes.items() if b["source"] != "auto" or b["page_index"] != e["page_index"]
            }
        elif op == "rescan_box":
            self.boxes = dict(self.boxes)
            self.new_box(e, "auto", self.policy[e["category"]])
        else:
            self.push()
            if op in SOURCES:
                self.new_box(e, SOURCES[op], True)
            elif op == "toggle_box" and box_id in self.boxes:
                self.boxes[box_id]["enabled"] = not self.boxes[box_id]["enabled"]
            elif op == "toggle_category":
                now = not self.policy[e["category"]]
                self.policy[e["category"]] = now
                for b in self.boxes.values():
                    if b["source"] == "auto" and b["category"] == e["category"]:
                        b["enabled"] = now
            elif op == "update_box" and box_id in self.boxes:
                b = self.boxes[box_id]
                if e["x0"] is not None:
                    b["xy"] = (e["x0"], e["y0"], e["x1"], e["y1"])
                if e["label"] is not None:
                    b["label"] = e["label"]
                if e["enabled"] is not None:
                    b["enabled"] = e["enabled"]
            elif op == "delete_box":
                self.boxes.pop(box_id, None)
                if self.selected == box_id:
                    self.selected = None


def fold(events):
    """{doc_id: Review} for dict events."""
    reviews = {}
    for e in sorted(events, key=lambda e: (e["doc_id"], e["seq"])):
        reviews.setdefault(e["doc_id"], Review()).apply(e)
    return reviews


def box_rows(reviews):
    return sorted(
        (d, i, b["page_index"], *b["xy"], b["source"], b["category"], b["label"], b["enabled"])
        for d, r in reviews.items()
        for i, b in r.boxes.items()
    )


def state_rows(reviews):
    return sorted(
        (d, r.selected, r.focus_count, len(r.past), len(r.future), *[r.policy[c] for c in CATEGORIES])
        for d, r in reviews.items()
    )
