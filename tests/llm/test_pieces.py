import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import pieces

text = st.text(alphabet="ab é. \n,!日。́🙂|", max_size=300)


@settings(max_examples=300, deadline=None)
@given(text, st.integers(1, 60), st.integers(0, 70), st.sampled_from([None, "\n", "\n\n", "|", " a"]))
def test_pieces_cover_the_text(t, limit, overlap, delimiter):
    found = pieces.cut(t, limit, overlap, delimiter)
    repeated = max(0, min(overlap, limit - 1))
    assert found[0][0] == 0 and found[-1][1] == len(t)
    assert (len(found) > 1) == (len(t) > limit)
    for (a, b, _), (c, d, _) in zip(found, found[1:]):
        assert c == b - repeated and d > b and a <= c
    assert all(b - a <= limit for a, b, _ in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab . \n,!|", min_size=1, max_size=120), st.integers(2, 40), st.integers(0, 12), st.sampled_from([None, "\n\n", "|"])), min_size=1, max_size=5))
def test_no_cuts_are_cheaper(many):
    """The cost is the least over all places of the text, with and without a boundary, however many texts are planned together."""
    for (t, limit, overlap, delimiter), found in zip(many, pieces.cut_all(many)):
        n, overlap = len(t), max(0, min(overlap, limit - 1))
        if n <= limit:
            continue
        room = limit - overlap
        equal = (n - overlap) / -(-(n - overlap) // room)
        marks, kinds = pieces._marks(t, delimiter, overlap, 10**9)
        cost = {x: pieces.COSTS[6] for x in range(overlap + 1, n)} | {int(x): pieces.COSTS[k] for x, k in zip(marks, kinds)} | {n: 0.0}
        best = {overlap: 0.0}
        for j in range(overlap + 1, n + 1):
            best[j] = min(best[i] + ((j - i - equal) / equal) ** 2 for i in range(max(overlap, j - room), j)) + cost[j]
        ends = [overlap, *(b for _, b, _ in found)]
        got = sum(((b - a - equal) / equal) ** 2 + cost[b] for a, b in zip(ends, ends[1:]))
        assert abs(got - best[n]) < 1e-6


def test_boundaries_are_natural():
    t = "First part is here. It goes on.\n\nSecond part follows. It ends.\n\nThird one."
    cuts = [(t[a:b], pieces.KINDS[k]) for a, b, k in pieces.cut(t, 40, 0, "\n\n")]
    assert [x[0] for x in cuts] == ["First part is here. It goes on.\n\n", "Second part follows. It ends.\n\n", "Third one."]
    assert [x[1] for x in cuts[:2]] == ["delimiter", "delimiter"]
    t = "a sentence of words. " * 10
    assert all(t[b - 2 : b] == ". " for _, b, _ in pieces.cut(t, 50)[:-1])
    assert pieces.cut("x" * 100, 30)[0][2] == len(pieces.KINDS) - 1
    with pytest.raises(ValueError):
        pieces.cut("x", 0)


def tables(spark):
    long = "Some words here. " * 20
    rows = [(1, "a", long, 1), (1, "a", long, 2), (2, "b", long, 1), (3, None, long, 1), (4, "x", long, 1), (5, "a", None, 1), (6, "a", "", 1), (7, "a", "y" * 100, 1), (8, "a", "y" * 101, 1), (9, "c", long, 1), (10, "d", long * 500, 1)]
    records = spark.createDataFrame([(*r, 0) for r in rows], "record_id bigint, source string, text string, loaded_at int, cap int")
    sources = [("a", 100, None, 10, "\n"), ("b", 500, 50, 0, None), ("c", None, None, 5, "\n"), ("d", 1000, 2000, 100, ". "), (None, 1, 1, 0, "\n")]
    return records, spark.createDataFrame(sources, "source string, chunk_size int, max_length int, chunk_overlap int, delimiter string")


def test_tables(spark):
    records, sources = tables(spark)
    assert sorted(r[0] for r in pieces.over_limit(records, sources).collect()) == [1, 2, 8, 10]
    rows = pieces.cut_texts(records, sources).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["piece"])):
        by.setdefault(r["record_id"], []).append(r)
    assert set(by) == {1, 2, 3, 4, 6, 7, 8, 9, 10}
    texts = {r["record_id"]: r["text"] for r in records.collect()}
    for k, parts in by.items():
        assert len(parts) == parts[0]["n_pieces"]
        whole = parts[0]["text"] + "".join(p["text"][q["stop"] - p["start"] :] for q, p in zip(parts, parts[1:]))
        assert whole == texts[k]
    assert max(len(p["text"]) for p in by[2]) <= 50
    assert pieces.cut_plan(records.limit(0), sources).count() == pieces.over_limit(records, sources.limit(0)).count() == 0
