import random

import numpy as np
import pytest

from strandmill.llm import folding, leaks


def test_hashes_of_equal_runs_are_equal():
    codes = np.array([ord(c) for c in "the cat and the cat and"], np.uint32)
    for q in (1, 2, 3, 5, 12):
        h = leaks.q_hashes(codes, q)
        assert len(h) == len(codes) - q + 1
        text = "the cat and the cat and"
        assert all((h[i] == h[j]) == (text[i : i + q] == text[j : j + q]) for i in range(len(h)) for j in range(len(h)))
    assert len(leaks.q_hashes(codes[:3], 12)) == 0


def aligned(a, b, shift, width):
    """One alignment by plain code: a cell is (score, matched, edits, run, first word)."""
    best, run, top, before = (0, 0, 0), 0, 0, {}
    for i, w in enumerate(a):
        now = {}
        for j in range(max(0, i + shift - width), min(len(b), i + shift + width + 1)):
            score, matched, edits, length, start = before.get(j - 1, (0, 0, 0, 0, j))
            if w == b[j]:
                cell = (score + 1, matched + 1, edits, length + 1, start if score else j)
                run = max(run, length + 1)
            else:
                cell = max((o[0] - 1, o[1], o[2] + 1, 0, o[4]) for o in (before.get(j - 1), before.get(j), now.get(j - 1), (0, 0, 0, 0, 0)) if o is not None)
            if cell[0] > 0:
                now[j] = cell
                if cell[0] > top:
                    top, best = cell[0], (cell[1], cell[2], cell[4])
        before = now
    return (run, *best)


def align(a, b, shift, width):
    code = {w: k + 2 for k, w in enumerate(dict.fromkeys([*a, *b]))}
    one, two = (np.array([7, *map(code.get, x), 9], np.uint64) for x in (a, b))
    return tuple(leaks.align(one, np.array([len(a)]), np.array([1]), two, np.array([1]), np.array([1 + len(b)]), np.array([shift]), width)[0].tolist())


def test_alignment():
    a = "one two three four five six seven eight nine ten".split()
    assert align(a, a, 0, 1)[:3] == (10, 10, 0)
    b = ["x", "y", *a[:5], "new", *a[5:]]
    assert align(a, b, 2, 2) == (5, 10, 1, 2)


def test_alignments_against_plain_code():
    rng = random.Random(5)
    cases = []
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 25))] for _ in range(2))
        at = rng.randrange(len(b))
        b[at:at] = a[: rng.randrange(len(a))]
        cases.append((a, b, rng.randrange(-3, 9), rng.choice([1, 4])))
    for width in (1, 4):
        some = [c for c in cases if c[3] == width]
        one, two = [c[0] for c in some], [c[1] for c in some]
        flat = lambda xs: np.array([ord(c) for x in xs for c in x], np.uint64)
        size = lambda xs: np.array([len(x) for x in xs])
        begin = np.cumsum(size(two)) - size(two)
        found = leaks.align(flat(one), size(one), np.cumsum(size(one)) - size(one), flat(two), begin, begin + size(two), np.array([c[2] for c in some]), width)
        expected = [aligned(*c) for c in some]
        assert [tuple(r[:3]) for r in found.tolist()] == [e[:3] for e in expected]
        assert [r[3] for r, e in zip(found.tolist(), expected) if e[1]] == [e[3] for e in expected if e[1]]


def fixture(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + list("abcdefgh")
    items, docs = [], []
    for i in range(40):
        question = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 30)))
        choices = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 18))) for _ in range(3)]
        items.append((i, f"Question: {question}?\nAnswer:" if i % 2 else question, choices))
    items += [(100, None, None), (101, "", [None, ""]), (None, items[0][1], items[0][2]), (102, items[5][1], [items[7][2][0]])]
    for i in range(200):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 2:
            _, p, c = rng.choice(items[:40])
            source = folding.words(rng.choice([p, *c]))
            n = rng.randrange(7, 14)
            at = rng.randrange(max(1, len(source) - n + 1))
            where = rng.randrange(len(ws) + 1)
            ws[where:where] = source[at : at + n]
        docs.append((i, rng.choice([" ", ",\n", " - "]).join(ws).upper() if i % 3 else " ".join(ws)))
    docs += [(500, None), (501, ""), (502, " "), (1, docs[1][1])]
    return spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, prompt string, choices array<string>")


def brute(docs, items, n=10):
    runs = {}
    for r in items.collect():
        for _, ws in leaks.passages(r["prompt"], r["choices"]):
            for k in range(len(ws) - n + 1):
                runs.setdefault(tuple(ws[k : k + n]), set()).add(r["item_id"])
    out = set()
    for d in docs.collect():
        ws = folding.words(d["text"])
        for k in range(len(ws) - n + 1):
            out |= {(d["doc_id"], i) for i in runs.get(tuple(ws[k : k + n]), ()) if i is not None}
    return out


@pytest.mark.parametrize("chars", [leaks.BLOCK_CHARS, 2000])
def test_every_leak_is_found(spark, chars):
    docs, items = fixture(spark)
    expected = brute(docs, items)
    assert len(expected) > 20
    found = leaks.find_leaks(docs, items, block_chars=chars).where("run >= 10").select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in found} == expected


def test_edits_within_the_budget(spark):
    ws = [f"passage{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(ws), ["x"])], "item_id bigint, prompt string, choices array<string>")
    docs = spark.createDataFrame([(1, " ".join(["before", *ws[:7], "changed", *ws[8:], "after"])), (2, "nothing of it")], "doc_id bigint, text string")
    rows = leaks.find_leaks(docs, items, 14, edits=9).collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert max(r["matched"] for r in rows) == 19 and min(r["edits"] for r in rows) == 1


@pytest.mark.parametrize("lead", range(8))
def test_dropped_word(lead):
    """A passage of 12 words of 6 letters without its 7th, wherever it stands in the text."""
    ws = [c + "abcde" for c in "mnopqrstuvwx"]
    index = leaks.build([(1, " ".join(ws), None)], leaks.Q, 10, 2)
    text = " ".join(["y" * lead] + ws[:6] + ws[7:])
    assert (11, 1) in {(matched, edits) for _, _, _, matched, edits, _ in leaks.search(index, [text], 2)}


def test_no_region_within_the_word_edits_is_lost():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 6, 14, 30]))) for _ in range(120)]
    lost, cases = [], 0
    for _ in range(400):
        a = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 20))]
        b = list(a)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + b + [rng.choice(vocabulary) for _ in range(9)]
        best = aligned(a, text, 0, len(a) + len(text))
        if best[1] >= 10 and best[2] <= 2:
            cases += 1
            found = list(leaks.search(leaks.build([(1, " ".join(a), None)], leaks.Q, 10, 2), ["other text", " ".join(text)], 2))
            if not any((t, m) == (1, best[1]) and e <= 2 for t, _, _, m, e, _ in found):
                lost.append((a, text, best, found))
    assert cases > 200 and not lost


@pytest.mark.parametrize("edits", [0, 2])
def test_common_passages(edits):
    """Words that all items share are left out where an item has others, and kept where it has none; nothing is lost."""
    rng = random.Random(3)
    shared = "which of the following statements about the old mill is true in every case today".split()
    items = [(i, " ".join(shared[:5] + [f"own{rng.randrange(500)}" for _ in range(14)]), None) for i in range(80)]
    items += [(100 + i, " ".join([*shared, f"end{i}"]), None) for i in range(60)]
    texts = [" ".join(["x", *shared, "y"]), " ".join([f"own{i}" for i in range(40)])]
    texts += [" ".join(["a", "b"] + items[i][1].split()[k : k + n] + ["c"]) for i in (3, 40) for k, n in ((0, 19), (3, 14), (5, 12), (7, 12), (9, 10))]
    for common in (50, 10**9):
        index = leaks.build(items, leaks.Q, 10, edits, common)
        found = {(t, index.items[g][0][0]) for t, g, run, matched, changed, _ in leaks.search(index, texts, edits) if (run >= 10 if not edits else matched >= 10 and changed <= 2)}
        if common == 50:
            mine, few = found, len(index.keys)
    assert mine == found and len(found) >= 60 and few <= len(index.keys) - 80 * 3


def test_best_region(spark):
    """All values of a row are those of one region."""
    ws = [f"passage{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(ws), ["x"])], "item_id bigint, prompt string, choices array<string>")
    docs = spark.createDataFrame([(1, " ".join([*ws[:11], "gap", *(f"z{i}" for i in range(20)), *ws[10:22], "new", *ws[22:]])), (2, " ".join(ws[:9]))], "doc_id bigint, text string")
    rows = [tuple(r) for r in leaks.leaked_regions(docs, items).select("doc_id", "item_id", "passage", "matched", "edits", "word").collect()]
    assert rows == [(1, 1, -1, 20, 1, 32)]


def test_report_and_empty(spark):
    docs, items = fixture(spark)
    tagged = items.selectExpr("*", "'t' as task", "'s' as split")
    report = {r["item_id"]: r["n_documents"] for r in leaks.leak_report(docs, tagged).where("item_id is not null").collect()}
    expected = brute(docs, items)
    assert report == {i: len({d for d, x in expected if x == i}) for i in report} and len(report) == 43
    assert leaks.leaked(docs.limit(0), items).count() == leaks.leaked(docs, items.limit(0)).count() == 0
