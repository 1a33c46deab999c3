"""Windows by summaries of segments against the fold over whole scopes."""

import datetime
import random

import numpy as np
import pytest

from loomspan.operators.windows import KINDS, OpenWindow, Summary, adaptive_windows

LIMITS = [({"document": 3, "mention": 5, "edge": 2}, 4, 30), ({"document": 1, "mention": 1, "edge": 1}, 0, 5), ({"document": 40, "mention": 60, "edge": 10**6}, 10, 90), ({"document": 7, "mention": 7, "edge": 7}, 20, 20)]


def fold(days, kinds, state, least, shortest, longest):
    return [state.add(d, k, least, shortest, longest) for d, k in zip(days, kinds, strict=True)]


@pytest.mark.parametrize("limits", LIMITS)
def test_a_summary_knows_the_exit_of_any_entry(limits):
    least, shortest, longest = limits
    rng = random.Random(str(limits))
    for _ in range(60):
        n = rng.randrange(1, 60)
        days = sorted(rng.randrange(0, rng.choice([3, 40, 300])) for _ in range(n))
        kinds = [rng.choice(KINDS) for _ in range(n)]
        made = Summary(np.array(days, np.int64), np.array(kinds, object), least, shortest, longest)
        entries = [(None, (0, 0, 0))] + [(days[0] - rng.randrange(0, longest), tuple(rng.randrange(0, 9) for _ in KINDS)) for _ in range(8)]
        for start, counts in entries:
            state = OpenWindow(5)
            state.start, state.counts = start, dict(zip(KINDS, counts, strict=True))
            fold(days, kinds, state, least, shortest, longest)
            left = (None, (0, 0, 0)) if state.start is None else (state.start, tuple(state.counts[k] for k in KINDS))
            assert made.leave((start, counts)) == (left, state.index - 5)


@pytest.mark.parametrize("limits", LIMITS[:3])
def test_segments_equal_the_fold_over_whole_scopes(spark, limits):
    rng = random.Random(7)
    first = datetime.date(2000, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), k, first + datetime.timedelta(rng.randrange(0, 600)), rng.choice(KINDS)) for k in range(900)]
    rows += [("one day", 2000 + k, first, rng.choice(KINDS)) for k in range(120)] + [(None, 1, first, "edge"), ("a", 2, None, "edge"), ("a", 3, first, "other")]
    events = spark.createDataFrame([(*r, "x") for r in rows], "scope string, event_id long, day date, kind string, n string").repartition(5)
    least, shortest, longest = limits
    whole = {tuple(r) for r in adaptive_windows(events, least, shortest, longest).collect()}
    want = set()
    for scope in {"hot", "a", "b", "one day"}:
        own = sorted((d, i, k) for s, i, d, k in rows if s == scope and d and k in KINDS)
        found = fold([(d - first).days for d, _, _ in own], [k for _, _, k in own], OpenWindow(), least, shortest, longest)
        want |= {(scope, i, d, n, why) for (d, i, _), (n, why) in zip(own, found, strict=True)}
    assert whole == want
    for segment in (1, 16, 100):
        assert {tuple(r) for r in adaptive_windows(events, least, shortest, longest, segment).collect()} == want
    assert adaptive_windows(events.limit(0), least, shortest, longest).collect() == []
