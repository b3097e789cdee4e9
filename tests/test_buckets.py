"""Many probes of one key of a stream's state, parsed and looked up together."""

import random

import numpy as np

from causeway.streaming import reader


def test_runs_of_many_probes_are_parsed_at_once():
    rnd = random.Random(5)
    runs, want = [], []
    for probe in range(300):
        at, held, run = 0, [], reader.Run(probe, 0, [])
        runs.append(run)
        for _ in range(rnd.randrange(4)):
            words = [rnd.choice([rnd.randrange(1, 99), 0x40000000 | 7, 0x80000000 | 9, 0xE0000000 | 3, 0xC0000001]) for _ in range(rnd.randrange(5))]
            start = at + rnd.choice([0, 0, 3])
            if start > at:
                run = reader.Run(probe, start, [], start - at, run)
                runs.append(run)
            run.parts.append(np.array(words, np.int64))
            at, held, lost, found = reader.advance(at, held, start, words)
            want += [(probe, start, lost)] if lost else []
            want += [(probe, place, 0, *e) for place, e in found]
        want.append((probe, held))
    frame = reader.frame_of(runs)
    got = [tuple(None if v is None or v is reader.pd.NA else v if isinstance(v, str) else int(v) for v in r) for r in frame.itertuples(index=False)]
    got = [r[:3] if r[2] else r for r in got]
    got += [(r.probe, r.rest.tolist()) for r in {r.probe: r for r in runs}.values()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 500


class Map(dict):
    """A map state that counts what is asked of it."""

    asked = 0

    def iterator(self):
        self.asked += 1
        return iter(self.items())

    def getValue(self, key):
        self.asked += 1
        return self[key]

    containsKey, updateValue = dict.__contains__, dict.__setitem__


class Value:
    row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class Handle:
    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()


def test_rows_of_a_bucket_come_in_one_go_where_many_are_asked_for():
    kept = reader.Kept(Handle(), "place", "probe long", "at long")
    for run in range(3):
        kept.open()
        rows = dict(kept.get((p,) for p in range(100)))
        assert rows == {(p,): (run - 1,) if run else None for p in range(100)}
        assert not list(kept.get([(5,)]))
        for p in range(100):
            kept.put((p,), (run,))
        kept.close()
    assert kept.map.asked == 2 and kept.count.row == (100,)
    kept.open()
    assert dict(kept.get([(7,), (500,)])) == {(7,): (2,), (500,): None} and kept.map.asked == 3
