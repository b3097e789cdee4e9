"""State of a bucket in pages and pieces: few calls for the rows and waiting chunks of many probes."""

import random

import numpy as np
import pandas as pd

from causeway.streaming import reader


class State:
    """Map and value states of one key; what is asked of them is counted."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map(self))

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value(self))

    def registerTimer(self, at):
        self.timers.add(at)


class Map:
    def __init__(self, state):
        self.state, self.rows = state, {}

    def getValue(self, key):
        self.state.calls += 1
        return self.rows.get(key)

    def containsKey(self, key):
        self.state.calls += 1
        return key in self.rows

    def updateValue(self, key, row):
        self.state.calls += 1
        self.rows[key] = row

    def removeKey(self, key):
        self.state.calls += 1
        del self.rows[key]

    def iterator(self):
        self.state.calls += 1
        return iter(list(self.rows.items()))


class Value:
    def __init__(self, state):
        self.state, self.row = state, None

    def exists(self):
        self.state.calls += 1
        return self.row is not None

    def get(self):
        self.state.calls += 1
        return self.row

    def update(self, row):
        self.state.calls += 1
        self.row = row

    def clear(self):
        self.state.calls += 1
        self.row = None


class Now:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs


def frame_of(chunks, deadline):
    probes, starts, words = zip(*chunks, strict=True)
    return pd.DataFrame({"probe_id": probes, "start": starts, "words": [np.array(w, np.int64) for w in words], "deadline": deadline})


def test_chunks_that_come_last_first_take_few_calls_of_the_state():
    rnd, state = random.Random(3), State()
    logs = {p: [rnd.choice([rnd.randrange(1, 99), 0x40000000 | 7, 0x80000000 | 9, 0xE0000000 | 3]) for _ in range(9)] for p in range(500)}
    cuts = {p: sorted(rnd.sample(range(1, 9), 2)) for p in logs}
    pieces = {p: list(zip([0, *c], [*c, 9], strict=True)) for p, c in cuts.items()}
    out = []
    for run in (2, 1, 0):
        gate = reader.EntryReader(1000)
        gate.init(state)
        # Every fifth probe lacks its first chunk, of every seventh the last one comes again, cut short the first time.
        chunks = [(p, a, logs[p][a : b - (p % 7 == 0 and run == 2)]) for p in logs for a, b in [pieces[p][run]] if run or p % 5]
        chunks += [(p, a, logs[p][a:b]) for p in logs if p % 7 == 0 and run == 1 for a, b in [pieces[p][2]]]
        out += [r for f in gate.handleInputRows((1,), iter([frame_of(chunks, 5000)]), Now(0)) for r in f.itertuples(index=False)]
    assert state.timers == {5000} and all(r.probe_id % 5 for r in out)
    out += [r for f in gate.handleExpiredTimer((1,), Now(5000), Now(5000)) for r in f.itertuples(index=False)]
    assert state.calls < 80
    want = []
    for p, log in logs.items():
        at, held, lost, found = reader.advance(0, [], 0 if p % 5 else cuts[p][0], log if p % 5 else log[cuts[p][0] :])
        want += [(p, cuts[p][0], lost)] if lost else []
        want += [(p, place, 0, e[0]) for place, e in found]
    assert sorted((r.probe_id, r.word_pos, r.missed) if r.missed else (r.probe_id, r.word_pos, 0, int(r.n_words)) for r in out) == sorted(want)
    # Nothing waits any more and no piece is left behind.
    assert not state.states["early"].rows and state.states["n_early"].row is None and state.states["waits"].row is None


def test_pages_are_split_as_rows_come_and_hold_them_all():
    rnd, state, rows = random.Random(4), State(), {}
    for run in range(8):
        kept = reader.Kept(state, "place", "probe long, epoch long", "n long")
        kept.open()
        keys = [(rnd.randrange(-9000, 9000), rnd.randrange(2)) for _ in range(600)] + rnd.sample(sorted(rows), min(len(rows), 50))
        assert dict(kept.get(keys)) == {k: rows.get(k) for k in keys}
        for k in keys:
            rows[k] = (run,)
            kept.put(k, rows[k])
        kept.close()
        sizes = [len(kept._read(at)) for (at,) in kept.map.rows]
        assert sum(sizes) == len(rows) == kept.n and max(sizes) < 2 * reader.PAGE and len(sizes) == reader.Kept.pages_of(len(rows))
    assert len(sizes) > 8
    before = state.calls
    kept.open()
    assert dict(kept.get([(10000, 5)])) == {(10000, 5): None} and state.calls == before + 2


def test_pieces_give_each_chunk_back_and_go_with_their_last(monkeypatch):
    monkeypatch.setattr(reader, "PIECE", 20)
    monkeypatch.setattr(reader, "HELD", 50)
    rnd, state, waiting = random.Random(5), State(), {}
    for run in range(40):
        pieces = reader.Pieces(state, "early")
        pieces.open()
        for i in range(60):
            if rnd.random() < (0.6 if run < 20 else 0.4) or not waiting:
                words = np.array([rnd.randrange(1 << 40) for _ in range(rnd.choice([0, 1, 5, 30]))], np.int64)
                waiting[run, i] = (words, pieces.put(words))
            else:
                words, at = waiting.pop(rnd.choice(sorted(waiting)))
                if rnd.random() < 0.2:
                    pieces.drop(at[0])
                else:
                    assert pieces.take(*at, len(words)).tolist() == words.tolist()
                assert pieces.n_read == sum(map(len, pieces.read.values())) and (pieces.n_read <= 50 or len(pieces.read) == 1)
        pieces.close()
        assert {k for (k,) in pieces.map.rows} == {at[0] for _, at in waiting.values()}
