from __future__ import annotations

import random

import pytest

from tidemark.llm import leakage as L

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(3000)]
SHARED = "read the extract below with care and answer in one short sentence now"
ITEMS = [(i, (SHARED + ". " if i % 2 else "") + " ".join(RNG.sample(VOCABULARY, 60 if i < 8 else 18))) for i in range(10)]


def index_of(items):
    """A whole small test set in memory."""
    cut = [(i, L.words(t)) for i, t in items]
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in cut for w in ws}))}
    seen = {}
    for i, ws in cut:
        for h in L.window_hashes(ws):
            seen.setdefault(h, set()).add(i)
    return L.ItemIndex([(i, ws, [p for p, h in enumerate(L.window_hashes(ws)) if len(seen[h]) > 1]) for i, ws in cut], vocabulary)


INDEX = index_of(ITEMS)
FILL = lambda n, seed: " ".join(random.Random(seed).choices([f"z{i}" for i in range(500)], k=n))


def own(i):
    return L.words(ITEMS[i][1])[13 if i % 2 else 0 :]


def found(text):
    return {i for i, _ in INDEX.leaks(text)}


@pytest.mark.parametrize("i", range(10))
@pytest.mark.parametrize("n,leak", [(12, True), (11, False)])
def test_runs(i, n, leak):
    for start in (0, 3, len(own(i)) - n):
        text = f"{FILL(40, i)} {' '.join(own(i)[start : start + n])} {FILL(40, start)}"
        assert (i in found(text)) == leak


def test_shared_wording_does_not_count():
    assert found(f"{SHARED} {FILL(10, 1)}") == set()
    assert found(SHARED + " " + " ".join(own(1)[:11])) == set()
    assert found(SHARED + " " + " ".join(own(1)[:12])) == {1}


def edited(words, at, how):
    out = []
    for k, w in enumerate(words):
        if k in at:
            if how == "drop":
                continue
            if how == "insert":
                out.append(w)
            out.append(f"q{k}")
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("how", ["replace", "drop", "insert"])
def test_edited_stretches(how):
    w = own(0)[10:34]
    assert 0 in found(" ".join([FILL(30, 1), *edited(w, {6, 12, 18}, how), FILL(30, 2)]))
    assert 0 in found(" ".join([FILL(30, 1), *edited(w, {5, 6, 17}, how), FILL(30, 2)]))
    assert 0 not in found(" ".join([FILL(30, 1), *edited(w, {4, 8, 12, 16, 20}, how), FILL(30, 2)]))
    assert 0 not in found(" ".join([FILL(30, 1), *edited(w[:20], {5, 10, 15}, how), FILL(30, 2)]))


def test_forms_do_not_matter():
    w = own(2)[:14]
    texts = [
        " ".join(w).upper(), ", ".join(w), "\n".join(w), "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>", "&nbsp; ".join(w), " ".join(x[0] + "​" + x[1:] for x in w),
        " ".join(chr(ord("ｗ")) + x[1:] for x in w), "> " + "\n> ".join(w), " ".join(f"**{x}**" for x in w), " ".join([*w[:5], w[5][:2] + "-\n" + w[5][2:], *w[6:]]), " ".join(x + "\xad" for x in w), "-".join(w),
    ]
    for t in texts:
        assert found(t) == {2}, t


def test_long_and_degenerate_texts():
    assert found("") == set() and INDEX.leaks(None) == [] and found("w1") == set() and found(" \n") == set()
    assert found(FILL(200_000, 3) + " " + " ".join(own(4))) == {4}
    assert found((" ".join(own(4)) + " ") * 300) == {4}


def test_stretch_against_plain_distance():
    import numpy as np

    def plain(item, region):
        for a in range(len(item) - 23):
            for n in range(24, min(47, len(item) - a) + 1):
                piece = item[a : a + n]
                if any(piece[0] == region[b] and piece[-1] == region[e - 1] and distance(piece, region[b:e]) <= n // 8 for b in range(len(region)) for e in range(b + n - 6, min(len(region), b + n + 6) + 1) if e > b):
                    return True
        return False

    def distance(p, q):
        row = list(range(len(q) + 1))
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(q, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for seed in range(12):
        r = random.Random(seed)
        item = [r.randrange(400) for _ in range(27)]
        region = edited(item, set(r.sample(range(1, 26), r.randrange(2, 6))), r.choice(["drop", "replace", "insert"]))
        region = [x if isinstance(x, int) else -1 for x in region]
        assert bool(L.edited_stretch(np.array(item), np.array(region))) == plain(item, region), seed


def test_tables(spark):
    items = spark.createDataFrame([*ITEMS, (20, None), (21, ITEMS[0][1]), (None, "x")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(own(0)), 5), (1, " ".join(own(0)), 5), (2, None, 5), (3, "", 5)], "doc_id bigint, text string, item_id int")
    got = sorted((r.doc_id, r.item_id) for r in L.find_leaks(docs, items).collect())
    assert got == [(1, 0), (1, 0), (1, 21), (1, 21)]
    assert L.find_leaks(docs.where("false"), items).count() == 0 and L.find_leaks(docs, items.where("false")).count() == 0


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    """Wording shared by items of different blocks does not count, words broken at a line's end are joined by all items' words."""
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    texts = [" ".join(own(i)) for i in range(8)] + [SHARED, SHARED + " " + " ".join(own(1)[:11]), " ".join(own(3)[:9]) + " " + own(3)[9][:2] + "-\n" + own(3)[9][2:] + " " + " ".join(own(3)[10:14])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = sorted(tuple(r) for r in L.find_leaks(docs, items).collect())
    for size in (1, 3):
        monkeypatch.setattr(L, "BLOCK_ITEMS", size)
        assert sorted(tuple(r) for r in L.find_leaks(docs, items).collect()) == whole
    assert {(d, i) for d, i, _ in whole} == {(i, i) for i in range(8)} | {(10, 3)}


def test_more_items_than_a_block_holds(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(2000)]
    many = [(i, SHARED + " " + " ".join(rng.choices(words, k=20))) for i in range(L.BLOCK_ITEMS + 300)]
    items = spark.createDataFrame(many, "item_id bigint, text string")
    docs = spark.createDataFrame([(0, many[5][1]), (1, many[-5][1]), (2, SHARED)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(docs, items).collect()} == {(0, 5), (1, L.BLOCK_ITEMS + 295)}


def test_long_tags_are_markup():
    assert L.words('a <a href="' + "x" * 2000 + '">b</a> c') == ["a", "b", "c"]
