import json

from caresift.operators import fold
from caresift.streaming.jobs import StayProcessor, Stored


class Map:
    def __init__(self):
        self.d = {}

    def getValue(self, k):  # noqa: N802
        return self.d.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.d[k] = v

    def containsKey(self, k):  # noqa: N802
        return k in self.d

    def removeKey(self, k):  # noqa: N802
        del self.d[k]

    def keys(self):
        return iter(list(self.d))


class Value:
    def __init__(self):
        self.v = None

    def get(self):
        return self.v

    def exists(self):
        return self.v is not None

    def update(self, v):
        self.v = v


class Rows(list):
    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *a):  # noqa: N802
        return Value()

    def getListState(self, *a):  # noqa: N802
        return Rows()

    def getMapState(self, *a):  # noqa: N802
        return Map()

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t // 1000)


def test_stored_entries():
    state = Map()
    m = Stored(state)
    m["a"], m["b"] = [1], [2]
    del m["b"]
    assert dict(m) == {"a": [1]} and state.d == {("a",): ("[1]",)}
    again = Stored(state)
    assert again.get("a") == [1] and again.get("zz", 7) == 7 and len(again) == 1
    del again["a"]
    again.flush()
    assert not state.d


def test_steps_are_those_of_polls():
    """Events that come one at a time, timers in between: the rows are those of one fold in polls."""
    e = fold.Event
    events = [e(1, "A04", 0, 0, "m1"), e(2, "A12", 3600, 3600, "m2", zst=("CANCELS", "m9", "A02", 7200)), e(3, "A01", 9000, 9000, "m3"), e(9, "A02", 7200, 8 * 86400, "m9"), e(10, "A03", 9 * 86400, 9 * 86400, "m10")]
    processor, handle, out = StayProcessor(poll_seconds=600, by_arrival=True), Handle(), []
    processor.init(handle)
    for event in events:
        while handle.timers and min(handle.timers) <= event.arrival:
            now = handle.timers.pop(handle.timers.index(min(handle.timers)))
            out += processor._step(("P",), now, []).to_dict("records")
        out += processor._step(("P",), event.arrival, [event]).to_dict("records")
    while handle.timers:
        out += processor._step(("P",), handle.timers.pop(0), []).to_dict("records")
    whole, poll = fold.PatientFold(), None
    for event in sorted(events, key=lambda x: (-(-(x.arrival + 300) // 600), x.at, x.receipt_id)):
        now = -(-(event.arrival + 300) // 600) * 600
        if poll not in (None, now):
            whole.finish(now - 600)
        poll = now
        whole.apply(event)
    whole.finish(30 * 86400)
    rows = list(whole.rows())
    told = lambda rows: [(r["kind"], r["receipt_id"], r["status"]) for r in rows if r["kind"] in ("event", "finding", "change")]
    assert told(out) == told(rows)
    last = {}
    for r in out:
        if r["kind"] == "stay":
            last[r["stay_id"]] = (r["revision"], r["pattern"], r["status"])
    assert last == {r["stay_id"]: (r["revision"], r["pattern"], r["status"]) for r in rows if r["kind"] == "stay"}
    assert json.loads(processor.small.v[0])["deadlines"] == []


def test_a_step_asks_only_for_what_is_there(monkeypatch):
    """A new patient's maps and buffer are not read, and a step that tells nothing gives no table; later steps read what was stored."""
    asked = []
    monkeypatch.setattr(Map, "getValue", lambda self, k: asked.append(k) or self.d.get(k))
    monkeypatch.setattr(Rows, "get", lambda self: asked.append("buffer") or iter(list(self)))
    e = fold.Event
    processor = StayProcessor(poll_seconds=600, by_arrival=True)
    processor.init(Handle())
    assert not list(processor._told(("P",), 0, [e(1, "A01", 0, 0, "m1")])) and not asked
    told = list(processor._told(("P",), 600, []))
    assert asked == ["buffer"] and [r["kind"] for r in json.loads(told[0]["told"][0])] == ["event", "stay", "segment"] and told[0]["patient_key"][0] == "P"
    cancel = e(2, "A11", 900, 900, "m2", zst=("CANCELS", "m1", "A01", 0))
    assert not list(processor._told(("P",), 900, [cancel]))
    rows = json.loads(next(processor._told(("P",), 1200, []))["told"][0])
    assert [(r["kind"], r["status"]) for r in rows] == [("change", "revoke_stay"), ("event", "applied"), ("stay", "cancelled")] and len(asked) > 3
