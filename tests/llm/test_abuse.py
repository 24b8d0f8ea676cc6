import pytest
from graphquarry.llm import abuse
from hypothesis import given, settings
from hypothesis import strategies as st

D, L = "doc_id bigint, text string, source string, score string", "doc_id bigint, reviewer string, verdict string, labelled_at timestamp"


def brute(scores):
    """Ruzzo and Tompa's definition: the best segment (shortest, leftmost on ties), then what lies left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    return brute(scores[:a]) + [(best[0])] + brute(scores[b:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments(scores):
    got = abuse.segments(scores)
    assert sorted(s for *_, s in got) == sorted(brute(scores))
    assert all(sum(scores[a:b]) == s for a, b, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("a,b", [("M.o.r.o.n", "moron"), ("morrrron", "moron"), ("m0r0n", "moron"), ("núdés", "nudes"), ("nаkеd", "naked"), ("na\u200bked", "naked"), ("$3x", "sex"), ("t i t s", "tits")])
def test_disguises(a, b):
    assert abuse.tokens(a) == abuse.tokens(b)


def test_tokens():
    assert abuse.tokens(None) == [] and abuse.tokens("") == [] and abuse.tokens("foldPage f(x)") == ["#foldPage", "f", "x"]
    assert abuse.tokens('lists "imbecile" here') == ["lists", "~imbecile", "here"]


def test_names():
    known = {"fuck": 1.0, "you": 1.0, "idiot": 1.0, "fold": -1.0}
    assert abuse.expand(["#iDiOt", "a", "#fuckYou", "#foldPage"], known) == ["idiot", "a", "fuck", "you", "#id"]


@pytest.fixture(scope="module")
def model():
    return abuse.make_model([], {}, 20_000)


#: None of these sentences is a seed; seeds are words and set phrases.
ABUSIVE = ["Listen here, brainless moron, and shut up.", "Only an i****t and a b****rd would sign off on this, asshole!", "One more word and I strangle you, kill you, both of you.", "Free porn with naked girls, hardcore sex all night.", "Solche Idioten, dieser Vollidiot von einem Wichser!", "Quel abruti, ce c0nnard de stagiaire", "Menudo imbécil, un gilipollas sin más", "Что за мудак и дебил это писал"]
CLEAN = ["We kill the child process when the parent dies.", "The master node waits for the slave node.", "Bare metal, hot reload and a hard limit are options.", "A dirty hack, but the build is green.", 'Row 7 of the word filter has "imbecile" on its list.', "It drops the oldest worker first.", "", None, " ", "The analyst from Scunthorpe will assess the titles."]


def test_seeds_are_no_sentences():
    from graphquarry.llm.abuse_seed import ABUSIVE as bad
    from graphquarry.llm.abuse_seed import HARMLESS as good

    assert max(len(x.split()) for x in [*bad, *good]) <= 3


@pytest.mark.parametrize("text", ABUSIVE)
def test_seeds_alone_find(model, text):
    pad = "The palette is closed before the scope is written. It drops the oldest worker first."
    assert model.measure(text)[1] >= 1 and model.measure(f"{pad}\n\n{text}\n\n{pad}")[1] >= 1


@pytest.mark.parametrize("text", CLEAN)
def test_seeds_alone_pass(model, text):
    assert model.measure(text)[1] == 0


def test_masked(model):
    assert model.score("m*n") > 1 and model.score("*") == abuse.OTHER and model.score("z*") == abuse.OTHER


def test_labels_teach_new_words():
    """Words that no seed has are learned from labels, with errors among them, and tried on texts left out."""
    import random

    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    text = lambda bad: [rng.choice(words) for _ in range(12)] + (["zorgling", "blarg", rng.choice(words)] if bad else []) + [rng.choice(words) for _ in range(12)]
    texts = [abuse.Labelled(text(k % 8 == 0), (2 if k % 8 == 0 else -2) * (-1 if k % 50 == 7 else 1)) for k in range(1200)]
    rng.shuffle(texts)
    m = abuse.make_model(texts, {}, 20_000)
    m = abuse.calibrate(m, [(0.5 + k / 8, int(4000 * 2.7 ** (-k / 8))) for k in range(64)], 400_000)
    assert m.heldout["recall"] > 0.8 and m.heldout["precision"] > 0.9
    assert m.measure("w1 w2 zorgling blarg w3")[1] == 1 and m.measure("w1 w2 w3 w4")[1] == 0


def test_calibration_finds_the_decay():
    m = abuse.make_model([], {}, 100)
    m = abuse.calibrate(m, [(k / 8 + 0.0625, round(1e6 * 2.718281828 ** (-0.7 * k / 8))) for k in range(160)], 10**7)
    assert abs(m.lam - 0.7) < 0.02
    # as many segments lie above a score as it foretells
    assert abs(m.chance(3.0, 10**7) / sum(round(1e6 * 2.718281828 ** (-0.7 * k / 8)) for k in range(24, 160)) - 1) < 0.1


def test_batches_equal_single_texts():
    """Whole batches as numbers give what text after text gives."""
    import pyarrow as pa

    m = abuse.Model({"moron": 2.0, "you": -0.2, "you moron": 3.0, "fuck": 1.0, "fuck you": 2.5, "the": -1.0, "the moron": -2.0, "#id": -1.0})
    texts = ["you moron. the moron", "fuckYou foldPage moron", "", None, "the the the", "moron", "a foldPage b moron moron"]
    said = [" ".join(abuse.tokens(t)) for t in texts]
    coder = abuse._Coder(m.weights)
    c = coder.code(pa.array([x or None for x in said]), m.weights)
    assert c.apart.tolist() == [False, True] + [False] * 5
    for k, t in enumerate(said):
        if t and not c.apart[k]:
            ts = abuse.expand(t.split(" "), m.weights)
            lo, hi = c.ends[k], c.ends[k + 1]
            assert [c.vocab[w] for w in c.at[lo:hi]] == ts
            assert [coder.pairs[p] if p >= 0 else None for p in c.key[lo:hi]] == [p if p in m.weights else None for _, p in abuse._units(ts)]


def test_cut():
    assert abuse._best_cut([(9, True), (8, True), *[(3, False)] * 9, (2, True), (1, False)])[1:] == (1.0, 2 / 3)
    assert abuse._best_cut([(9, True), (8, True), (3, False)])[0] == 5.5


def test_verdicts(spark):
    rows = [(1, "a", "abusive", None), (1, "b", "abusive", None), (1, "c", "clean", None), (2, "a", "clean", None), (2, "a", "clean", None), (3, "a", "abusive", None), (3, "b", "clean", None), (4, "a", "unsure", None), (None, "a", "clean", None), (5, "a", None, None)]
    assert {tuple(r) for r in abuse.verdicts(spark.createDataFrame(rows, L)).collect()} == {(1, 1), (2, -1)}


def test_flagged_and_rates(spark):
    docs = [(1, "Listen, worthless moron, pathetic loser!", " Forum/ X ", "s"), (2, "The parser kills its child process.", "forum/x", "s"), (3, None, None, "s"), (4, "", "", "s"), (5, "fine words " * 5000 + "fucking moron, worthless bastard, pathetic scumbag, imbecile, asshole", "forum/x", "s")]
    docs += [(k, "It drops the oldest worker first.", "forum/y", "s") for k in range(10, 200)]
    df = spark.createDataFrame(docs, D)
    labels = spark.createDataFrame([(1, "a", "abusive", None), (2, "a", "clean", None)], L)
    assert sorted(r["doc_id"] for r in abuse.flagged(df, labels).collect()) == [1, 5]
    assert {(r["source"], r["docs"], r["flagged"]) for r in abuse.rates(df, labels).collect()} == {("forum/x", 3, 2), (None, 1, 0), ("", 1, 0), ("forum/y", 190, 0)}
    assert abuse.flagged(df.filter("false"), labels).count() == 0
    assert sorted(r["doc_id"] for r in abuse.flagged(df, labels.filter("false")).collect()) == [1, 5]


@pytest.mark.parametrize("text", ["iDiOt aNd a mOrOn", "wOrThLeSs mOrOn", "fuckYou", '"fuck you"', "`fuck you`", 'A "worthless moron".', "„fuck you“", 'She said "the oldest worker is dropped first here" and then "worthless moron" too'])
def test_case_and_quotes_hide_nothing(model, text):
    assert model.measure(text)[1] >= 1


@pytest.mark.parametrize("text", ["foldPage killChild nakedPtr dieRoll", 'The filter blocks "fuck you".', 'It drops "the oldest worker of them all" and the list has "fuck you" as a banned word.'])
def test_names_and_cited_words_pass(model, text):
    assert model.measure(text)[1] == 0
