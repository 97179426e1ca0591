import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import windows


def best_fit(lengths, capacity):
    """Windows of records placed one after another, the longest first, each in the tightest window that has room."""
    out = []
    for n in sorted(lengths, reverse=True):
        room = [(left, i) for i, (left, _) in enumerate(out) if left >= n]
        if room:
            left, i = min(room)
            out[i] = (left - n, [*out[i][1], n])
        else:
            out.append((capacity - n, [n]))
    return Counter(capacity - left for left, _ in out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 33))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    made = defaultdict(list)
    seen = Counter()
    for length, first, last, per, window, place in windows.plan(list(Counter(lengths).items()), capacity):
        for r in range(first, last + 1):
            seen[length, r] += 1
            at = place + (r - first) % per * length
            made[window + (r - first) // per].append((at, length))
    assert all(n == 1 for n in seen.values()) and len(seen) == len(lengths)
    for parts in made.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= capacity
    assert sorted(made) == list(range(len(made)))
    # Which of equally tight windows is taken is open; how full the windows are at the end is not.
    assert Counter(sum(n for _, n in x) for x in made.values()) == best_fit(lengths, capacity)


def tables(spark):
    rows = [(1, "train", 5, 1), (1, "train", 5, 2), (2, "train", 10, 1), (3, "train", 11, 1), (4, "train", 35, 1), (5, "train", 0, 1), (6, "train", None, 1), (7, "val", 50, 1), (8, "train", 5, None), (None, "train", 5, 1)]
    records = spark.createDataFrame([(*r, "x", 9) for r in rows], "record_id bigint, split string, n_tokens int, prepared_at int, text string, window int")
    experiments = spark.createDataFrame([("a", 10, 20), ("b", 40, 20), ("c", None, 5), (None, 5, 5), ("z", 0, 5)], "experiment string, max_length int, max_seq_length int")
    return records, experiments


def test_pack(spark):
    records, experiments = tables(spark)
    packed = windows.pack(records, experiments)
    rows = packed.collect()
    assert {r["experiment"] for r in rows} == {"a", "b"}
    a = [r for r in rows if r["experiment"] == "a"]
    by = Counter(r["record_id"] for r in a)
    assert by == {1: 1, 2: 1, 3: 2, 4: 4, 5: 1, 6: 1, 8: 1}
    assert {r["record_id"] for r in a if r["window"] is None} == {5, 6}
    used = Counter()
    for r in a:
        used[r["window"]] += r["length"] or 0
    assert max(v for k, v in used.items() if k is not None) <= 10 and sum(used.values()) == 66
    assert sorted(map(tuple, windows.divided(packed, experiments).collect())) == [("a", 3), ("a", 4)]
    u = {r["experiment"]: r for r in windows.unused(packed, experiments).collect()}
    assert (u["a"]["n_windows"], u["a"]["unused"], u["b"]["capacity"]) == (7, 4, 20)


def test_every_record_has_its_place(spark, monkeypatch):
    """Hot lengths in several blocks, records over the capacity: windows hold what fits, without a gap between records."""
    monkeypatch.setattr(windows, "BLOCK_ROWS", 20)
    rng = random.Random(1)
    lengths = {i: rng.choice([7, 7, 7, *range(1, 60)]) for i in range(600)}
    records = spark.createDataFrame([(i * 10**12, "train", n, 1) for i, n in lengths.items()], "record_id bigint, split string, n_tokens int, prepared_at int")
    experiments = spark.createDataFrame([("a", 20, 20), ("b", 64, 64)], "experiment string, max_length int, max_seq_length int")
    rows = windows.pack(records, experiments).collect()
    for name, capacity in (("a", 20), ("b", 64)):
        mine, made = Counter(), defaultdict(list)
        for r in rows:
            if r["experiment"] == name:
                mine[r["record_id"] // 10**12] += r["length"]
                made[r["window"]].append((r["place"], r["length"]))
        assert mine == lengths
        pieces = [n for x in lengths.values() for n in [capacity] * (x // capacity) + [x % capacity] * (x % capacity > 0)]
        assert Counter(sum(n for _, n in x) for x in made.values()) == best_fit(pieces, capacity)
        for parts in made.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity


def test_empty(spark):
    records, experiments = tables(spark)
    assert windows.pack(records.limit(0), experiments).count() == 0
    assert windows.pack(records, experiments.limit(0)).count() == 0
