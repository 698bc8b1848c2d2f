"""Queries that once did a part of the job, against plain Python on small tables."""

import datetime

from cuewright.plans import queries as plans

DAY = 86400


def taped(spark, path):
    """Events of four users: sessions of three hours, some users' and some times' only once."""
    at = {1: [0, 40], 2: [10, 60], 3: [20, 21], 4: [80, 81, 120]}  # hours at which a session begins
    hours = [(u, 3600 * h + 3600 * k) for u, begins in at.items() for h in begins for k in range(4)]
    rows = [(n, u, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), 1.0) for n, (u, t) in enumerate(hours)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").write.parquet(f"{path}/events.parquet")
    return [(n, u, t.timestamp()) for n, u, t, _ in rows]


def sessions(events):
    out = []
    for u in sorted({e[1] for e in events}):
        times = sorted(t for _, v, t in events if v == u)
        runs = [[times[0]]]
        for t in times[1:]:
            runs[-1].append(t) if t - runs[-1][-1] <= 4 * 3600 else runs.append([t])
        out += [(u, r[0], r[-1]) for r in runs if r[-1] > r[0]]
    return out


def test_every_user_is_intersected(spark, tmp_path):
    events = taped(spark, tmp_path)
    got = {r["id_b"]: (r["parts"], r["seconds"]) for r in plans.queries()["u4_intersect"](spark, str(tmp_path)).collect()}
    isles = []
    for u, s, e in sorted((u, s - 7200, e + 7200) for u, s, e in sessions(events)):
        if isles and isles[-1][0] == u and s <= isles[-1][2]:
            isles[-1][2] = max(isles[-1][2], e)
        else:
            isles.append([u, s, e])
    want = {}
    for u in {e[1] for e in events}:
        own = [t for _, v, t in events if v == u]
        parts = [min(e, max(own)) - max(s, min(own)) for _, s, e in isles if s < max(own) and min(own) < e]
        want[u] = (len(parts), sum(parts))
    assert got == want and {2, 4} <= set(got)


def test_points_in_any_session(spark, tmp_path):
    events = taped(spark, tmp_path)
    got = {r["p"]: (r["ord"], r["at"]) for r in plans.queries()["j6_point_in_interval"](spark, str(tmp_path)).collect()}
    tape = sorted((s, u, e) for u, s, e in sessions(events))
    assert got == {p: next((k, t - s) for k, (s, _, e) in enumerate(tape, 1) if s <= t <= e) for p, _, t in events}


def test_phrases_beside_other_characters(spark, tmp_path):
    phrases = ["The quick brown fox jumps over it", "five words and no more", "two words", "word", "a phrase\nof two lines, eight\twords long", " blank at both of its two ends ", "ends in a full stop, it does.", None]
    texts = [None, "", *[x for p in phrases[:-1] for x in (p, f"foo\n{p}", f"foo\t{p}\nbar", f'he said "{p}"', f"[{p}]", f"{p}.", f"x{p}y", p.replace(" ", "  "), p[:-1])]]
    spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.queries()["j5_forbidden_phrases"](spark, str(tmp_path)).collect()
    want = [(d, i) for d, t in enumerate(texts) for i, p in enumerate(phrases) if t is not None and p is not None and p in t]
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
