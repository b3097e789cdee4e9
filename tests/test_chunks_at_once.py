"""Many chunks of a log at once, against one word after the other."""

import random

import numpy as np

from causeway.operators import entries, scan

POOL = [1, 2, 0x40000007, 0x80000009, 0xC0000001, 0xE0000001, 0xFFFFFFFF, 0]


def chunks(rnd, n, longest):
    logs = [[rnd.choice(POOL) for _ in range(rnd.randrange(longest))] for _ in range(n)]
    return logs, np.array([w for log in logs for w in log], np.int64), np.array([len(log) for log in logs], np.int64)


def test_functions_and_borders_of_many_chunks():
    rnd = random.Random(8)
    for longest in (1, 2, 9, 70):
        logs, words, sizes = chunks(rnd, 500, longest)
        codes = scan.transfers(words, sizes)
        states = np.array([rnd.randrange(4) for _ in logs])
        first, last = scan.borders(words, sizes, states)
        for log, code, state, lo, hi in zip(logs, codes.tolist(), states.tolist(), first.tolist(), last.tolist(), strict=True):
            for begun in range(4):
                want = begun
                for w in log:
                    want = {0: 2 if w >> 29 == 7 else 1 if w >> 30 else 0, 1: 0, 2: 3, 3: 1 if w >> 30 else 0}[want]
                assert scan.after(code, begun) == want
            n = 0
            while state and n < len(log):
                state = {1: 0, 2: 3, 3: 1 if log[n] >> 30 else 0}[state]
                n += 1
            assert lo == n and hi == len(log) - len(entries.entries_of(log[n:])[1])


def test_no_chunks():
    none = np.zeros(0, np.int64)
    assert len(scan.transfers(none, none)) == 0 and [len(x) for x in scan.borders(none, none, none)] == [0, 0]
