import random

from graphquarry.llm import leak
from hypothesis import given, settings
from hypothesis import strategies as st

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, item_text string, text string"


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def naive_tiles(a, b, n):
    """Greedy string tiling as published: the longest match of unmarked words, again and again."""
    ma, mb, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in ma and j + k not in mb:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < n:
            return sorted(out)
        out.append((i, j, k))
        ma |= set(range(i, i + k))
        mb |= set(range(j, j + k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("xyz"), max_size=14), st.lists(st.sampled_from("xyz"), max_size=14))
def test_tiles_cover_as_published(a, b):
    seeds = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2]]
    got = leak.tiles(seeds, 2)
    assert all(a[i : i + n] == b[j : j + n] and n >= 2 for i, j, n in got)
    assert sum(n for *_, n in got) == sum(n for *_, n in naive_tiles(a, b, 2))
    spans = [i + k for i, _, n in got for k in range(n)]
    assert len(spans) == len(set(spans))


def test_words():
    assert leak.words("<p>Foo <b>BAR</b>&amp; baz-\nqux</p> na\u200bked ﬁle") == ["foo", "bar", "bazqux", "naked", "file"]
    assert leak.words(None) == [] and leak.words(" \n") == []


def test_leaks(spark):
    intro, own = sentence(1, 12), {k: sentence(10 + k, 40) for k in range(1, 5)}
    items = [(k, f"{intro}. {t}", "x") for k, t in own.items()] + [(5, None, "x"), (6, "", "x")]
    w = own[2].split()
    differs = " ".join("zz" if k in (7, 15) else x for k, x in enumerate(w[:26]))
    docs = [
        (1, f"before {own[1]} after", ""), (2, sentence(99, 60), ""), (3, intro + " " + sentence(98, 30), ""), (4, "<p>" + own[3].upper().replace(" ", ",\n**") + "</p>", ""),
        (5, differs, ""), (6, " ".join(w[20:40]) + " junk " + " ".join(w[0:20]), ""), (7, " ".join(own[4].split()[:10]), ""), (8, None, ""), (9, "", ""), (10, own[1] + " " + own[2], ""), (10, own[1] + " " + own[2], ""), (11, sentence(97, 3000) + " " + own[4], ""),
    ]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items + items[:1], ITEMS)
    got = sorted((r["doc_id"], r["item_id"]) for r in leak.leaks(d, i).collect())
    want = [(1, 1), (4, 3), (5, 2), (6, 2), (10, 1), (10, 1), (10, 2), (10, 2), (11, 4)]
    assert got == want
    blocks = leak.coverage(d, i, block_words=60).filter(f"own_words >= {leak.OWN_WORDS * (1 - leak.MAY_DIFFER)}")
    assert sorted((r["doc_id"], r["item_id"]) for r in blocks.collect()) == want
    assert leak.leaks(d.filter("false"), i).count() == 0 and leak.leaks(d, i.filter("false")).count() == 0


def test_long_tags_are_markup():
    from graphquarry.llm.leak import words

    assert words('one <a href="' + "x/" * 400 + '" class=\'b\' hidden>two</a> three') == ["one", "two", "three"]
    assert words("a <b " + "c " * 300 + "< d") == ["a", "b", *["c"] * 300, "d"]
