import random

import numpy as np
import pytest

from tallyspan.llm import leakage
from tallyspan.llm.words import hashed_words, plain_bytes

DOCS = "doc_id long, text string, passage string, item_id long"
ITEMS = "item_id long, passage string, text string"


def test_hashes_do_not_depend_on_place_or_slicing():
    long = b" ".join(b"w%d" % (i % 977) for i in range(2_000_000))
    words, bounds = hashed_words([b"", b"alpha  beta", long, b"beta"])
    assert bounds.tolist() == [0, 0, 2, 2_000_002, 2_000_003] and words[1] == words[-1] and words[2] == words[2 + 977]
    assert len(np.unique(words)) == 979


@pytest.mark.parametrize("text", ["The <b>OLD</b> map-room", "ｔｈｅ öld́ map­Room".replace("ma", "ma").replace("p­R", "p R"), "the\nold*map_room", "the&nbsp;old “map” room"])
def test_plain(text):
    assert plain_bytes(text).split() == [b"the", b"old", b"map", b"room"]


def words_of(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(4000)}" for _ in range(n)]


def altered(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(1, len(words) - 1)
        kind = rng.randrange(3)
        words[i : i + 1] = [["zz"], [], [words[i], "zz"]][kind]
    return words


def test_recall_and_exactness(spark):
    rng = random.Random(11)
    items = {i: words_of(rng, rng.randrange(40, 120)) for i in range(60)}
    docs, held = [], set()
    for d in range(240):
        item = rng.randrange(60)
        n = len(items[item])
        body = words_of(rng, 150)
        if d % 3 == 0:  # a stretch that counts, with fewer edits than allowed
            size = rng.randrange(n // 2, n + 1)
            start = rng.randrange(n - size + 1)
            body[70:70] = altered(rng, items[item][start : start + size], size // 12)
            held.add((d, item))
        elif d % 3 == 1:  # too short
            body[70:70] = items[item][: leakage.needed(n) - 2]
        else:  # too many edits
            piece = items[item][: n // 2 + 5]
            body[70:70] = [w if i % 5 else "zz" for i, w in enumerate(piece)]
        docs.append((d, " ".join(body), "clash", 1))
    rows = [*docs, (900, None, None, None), (901, "", None, None), (902, " ".join(items[3]), None, None), (902, " ".join(items[3]), None, None)]
    found = leakage.leaked(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(70, None, None), (71, " ", None)], ITEMS))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted([*held, (902, 3), (902, 3)])


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b", "x", 1)], DOCS), spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert leakage.leaked(docs, items.limit(0)).count() == 0 and leakage.leaked(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in leakage.leaked(docs, items).collect()] == [(1, 1)]


def at_the_limit(rng, passage, kind):
    """Two fifths of a passage with as many edits as they allow, in one place or scattered."""
    need = leakage.needed(len(passage))
    edits = need // leakage.PER_EDIT
    held = need + (edits if "put in" not in kind else 0)
    start = rng.randrange(len(passage) - held + 1)
    stretch = passage[start : start + held]
    fresh = [f"new{rng.randrange(10**6)}" for _ in range(edits)]
    if kind.startswith("together"):
        middle = min(held // 2, held - edits - 1)
        return stretch[:middle] + ([] if "left out" in kind else fresh) + stretch[middle if "put in" in kind else middle + edits :]
    places = sorted(rng.sample(range(1, held - 1), edits), reverse=True)
    for place, word in zip(places, fresh):
        stretch[place : place + ("put in" not in kind)] = [] if "left out" in kind else [word]
    return stretch


@pytest.mark.parametrize("kind", [f"{where}, {what}" for where in ("together", "scattered") for what in ("altered", "put in", "left out")])
def test_recall_at_the_limit(kind):
    rng = random.Random(23)
    for n, least in ((45, 0.97), (54, 0.97), (80, 0.97), (121, 0.97), (160, 0.97), (240, 0.95), (300, 0.95)):
        passages = [words_of(rng, n) for _ in range(40)]
        index = leakage.build_index(list(range(40)), [" ".join(p) for p in passages])
        docs = [" ".join([*words_of(rng, 60), *at_the_limit(rng, p, kind), *words_of(rng, 60)]) for p in passages]
        found = leakage.matches(index, *hashed_words([plain_bytes(d) for d in docs]))
        assert len(found) >= least * 40 and (found[:, 0] == found[:, 1]).all(), (n, len(found))


def test_markup_of_any_length():
    assert plain_bytes("a &CounterClockwiseContourIntegral; b").split() == [b"a", b"b"]
    assert plain_bytes(f"a <a title='{'x ' * 300}'>b</a> c < d > e").split() == [b"a", b"b", b"c", b"d", b"e"]
