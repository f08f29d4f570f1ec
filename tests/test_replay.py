"""The replay's own definitions: the horizon study and episodes broken by zones."""

import random

from gridpulse.operators import replay


def reference_study(samples, cutoff, h, names):
    """The study of one stream step by step: thresholds, hits of event windows, and of normal windows."""
    def features(w):
        t, v = [x[0] for x in w], [x[1] for x in w]
        span, mean = t[-1] - t[0], sum(v) / len(v)
        return dict(zip(names, (
            v[-1], max(v), mean, (v[-1] - v[0]) / span if span else 0.0, (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5,
            max((b - a for a, b in zip(t, t[1:])), default=0.0), max(0.0, 1 - len(v) / (span / 15 + 1)),
        )))

    def windows(rows):
        start = rows[0][0]
        while start + h <= rows[-1][0]:
            if w := [x for x in rows if start <= x[0] < start + h]:
                yield features(w)
            start += 60

    def quantile(xs, p):
        xs, rank = sorted(xs), p * (len(xs) - 1)
        lo = int(rank)
        return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (rank - lo)

    cal = list(windows([x for x in samples if x[0] < cutoff]))
    limit = {f: quantile([c[f] for c in cal], 0.99) for f in names}
    events = []
    for i in range(1, len(samples)):
        if samples[i - 1][1] < 100 <= samples[i][1] and samples[i][0] >= cutoff:
            back = next((t for t, v in samples[i + 1 :] if v < 100), None)
            events.append((max(samples[i][0] - 60, events[-1][2] if events else 0), samples[i][0], back))
    normal = list(windows([x for x in samples if x[0] >= cutoff and not any(a < x[0] and (c is None or x[0] <= c) for a, _, c in events)]))
    before = [features(w) for _, c, _ in events if (w := [x for x in samples if c - h <= x[0] < c])]
    over = lambda rows, f: sum(r[f] > limit[f] for r in rows)
    return {f: (round(limit[f], 4), over(before, f), len(events), round(over(normal, f) / len(normal), 4), len(normal)) for f in names}


def test_horizon_study_follows_the_definition(spark):
    r, samples, t = random.Random(5), [], 0.0
    for _ in range(900):
        t += r.choice([5.0, 15.0, 15.0, 40.0])
        samples.append((t, round(r.gauss(60, 18), 2)))
    cutoff = 9000.0
    df = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(samples)], "user_id long, idx long, ts_min double, value double")
    got = replay.horizon_study(df, cutoff, ["user_id"], (60.0, 360.0)).collect()
    for h in (60.0, 360.0):
        assert {x["feature"]: tuple(x)[2:] for x in got if x["horizon_min"] == h} == reference_study(samples, cutoff, h, replay.FEATURES)


def test_a_zone_ends_an_episode(spark):
    day = 1440.0
    rows = [(0, 0.0, True, None), (1, 10.0, True, 1), (2, day, True, None), (3, day + 1, True, None), (4, day + 2, False, None), (5, day + 3, None, None), (6, 2 * day, True, 2), (7, 3 * day, False, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "user_id long, idx long, ts_min double, flagged boolean, event_id long")
    got = replay.episodes_by_day(replay.replay_episodes(df, ["user_id"]), df).collect()
    assert {r["day"]: r["n_episodes"] for r in got} == {0: 1, 1: 1, 3: 0}
