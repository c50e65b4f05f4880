"""The label stage against going through turbines one by one."""

import random

import pytest

from gridloom.operators import labelling as B

CAUSES = ("technical", "environmental")
SETS = {"narrow": ("technical",), "broad": CAUSES}
STEP = 10


def runs_of(seconds, chosen):
    """start, end, seconds of runs of consecutive steps with seconds of the chosen causes. seconds: step -> cause -> s, and '' the total."""
    out = []
    for s in sorted(seconds):
        v = min(sum(seconds[s].get(c, 0) for c in chosen), seconds[s][""])
        if v <= 0:
            continue
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], s + STEP, out[-1][2] + v)
        else:
            out.append((s, s + STEP, v))
    return out


def status_seconds(stops):
    held = {}
    for start, end, cause in stops:
        for t in range(start, end):
            held.setdefault(t, set()).add(cause)
    out = {}
    for t, named in held.items():
        step = out.setdefault(t // STEP * STEP, {"": 0})
        step[""] += 1
        for c in named:
            step[c] = step.get(c, 0) + 1
    return out


def test_events_and_labels_for_all_durations_match_one_by_one(spark):
    rng = random.Random(5)
    stops, grid, want_events, want_tally = [], [], {}, {}
    durations, horizons = [4, 12, 30], [3, 6]
    seconds = {}
    for turbine in ("a", "b", "c"):
        mine = []
        for _ in range(25):
            start = rng.randrange(900)
            mine.append((start, start + rng.choice([0, 3, 8, 25, 60]), rng.choice([*CAUSES, "other"])))
        stops += [(turbine, *m) for m in mine] + [(turbine, 5, None, "technical")]
        seconds["S", turbine] = status_seconds([m for m in mine if m[2] in CAUSES])
        grid += [("S", turbine, s, rng.random() < 0.5) for s in range(0, 1000, STEP) if s % 170 != 0]
    down, timers = [], []
    for turbine in ("a", "z"):
        seconds["D", turbine] = {}
        for s in range(0, 600, STEP):
            d, a, b = rng.choice([0, 0, 7, 15]), rng.randrange(12), rng.randrange(12)
            down.append((turbine, s, d))
            timers.append((turbine, s, a, b))
            total = max(0, min(STEP, d))
            seconds["D", turbine][s] = {"": total, "technical": min(a, total), "environmental": min(b, total)}
            grid.append(("D", turbine, s, True))
    faults = [("e", 100, 130), ("e", 400, 410), ("e", None, 5)]
    grid += [("E", "e", s, True) for s in range(0, 500, STEP)]
    df = spark.createDataFrame
    sources = {
        "S": B.StopSource("status", df(stops, "turbine string, start long, end long, cause string")),
        "D": B.StopSource("downtime", downtime=df(down, "turbine string, step long, downtime_s long"), timers=df(timers, "turbine string, step long, a long, b long"), timer_causes={"technical": ["a"], "environmental": ["b"]}),
        "E": B.StopSource("events", df(faults, "turbine string, start long, end long")),
    }
    frame = df(grid, "source string, turbine string, step long, data boolean")
    out = B.label_sources(sources, frame, SETS, CAUSES, durations[::-1], horizons, STEP, lambda: frame["data"])
    starts = {}
    for (source, turbine), held in seconds.items():
        for name, chosen in SETS.items():
            for start, end, s in runs_of(held, chosen):
                starts.setdefault((source, turbine, name), []).append((start, sum(d <= s for d in durations)))
                want_events[source, turbine, name, start] = (end, s)
    for turbine, start, end in faults[:2]:
        for name in SETS:
            starts.setdefault(("E", turbine, name), []).append((start, 3))
            want_events["E", turbine, name, start] = (end, None)
    got = {(r["source"], r["turbine"], r["set"], r["start"]): (r["end"], r["seconds"]) for r in out.events.collect()}
    assert got == want_events
    at = {(s, t, k): d for s, t, k, d in grid}
    counts = {(r["source"], r["set"], r["duration"]): (r["events"], r["in_grid"]) for r in out.counts.collect()}
    for source in sources:
        for name in SETS:
            for k, d in enumerate(durations, 1):
                mine = [(t, s) for (src, t, n), rows in starts.items() if (src, n) == (source, name) for s, level in rows if level >= k]
                assert counts[source, name, d] == (len(mine), sum((source, t, s // STEP * STEP) in at for t, s in mine))
                for h in horizons:
                    tally = [0] * 5
                    for (src, t, s), data in at.items():
                        if src != source:
                            continue
                        hit = any(s < x <= s + h * STEP and level >= k for x, level in starts.get((source, t, name), []))
                        known = hit or all((source, t, s + i * STEP) in at for i in range(1, h + 1))
                        for i, yes in enumerate((True, known, hit, known and data, hit and data)):
                            tally[i] += yes
                    want_tally[source, name, d, h] = tuple(tally)
    tallies = {(r["source"], r["set"], r["duration"], r["horizon"]): tuple(r[c] for c in ("steps", "known", "positive", "known_with_data", "positive_with_data")) for r in out.tallies.collect()}
    assert tallies == want_tally


def test_sources_without_events_and_unknown_kinds(spark):
    none = spark.createDataFrame([], "turbine string, start long, end long, cause string")
    grid = spark.createDataFrame([("S", "a", s) for s in range(0, 50, STEP)], "source string, turbine string, step long")
    out = B.label_sources({"S": B.StopSource("status", none)}, grid, SETS, CAUSES, [5], [2], STEP)
    assert {(r["events"], r["in_grid"]) for r in out.counts.collect()} == {(0, 0)} and out.counts.count() == 2
    assert {(r["known"], r["positive"]) for r in out.tallies.collect()} == {(3, 0)}
    with pytest.raises(ValueError, match="rule"):
        B.label_sources({"S": B.StopSource("guess", none)}, grid, SETS, CAUSES, [5], [2], STEP)


def test_events_under_changed_causes(spark):
    from pyspark.sql import functions as F

    stops = spark.createDataFrame([("a", 0, 30, "environmental"), ("a", 100, 112, "technical")], "turbine string, start long, end long, cause string")
    moved = {"all technical": lambda df: df.withColumn("cause", F.lit("technical"))}
    got = {r["change"]: (r["events"], r["seconds"]) for r in B.changed_causes(B.StopSource("status", stops), moved, ["technical"], CAUSES, 5, STEP).collect()}
    assert got == {"": (1, 12), "all technical": (2, 42)}
