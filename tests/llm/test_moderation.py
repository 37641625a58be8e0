import random

import numpy as np
import pytest

from kinolake.llm import moderation
from kinolake.llm.moderation import GROUPS as WORDS_FOR_GROUPS
from kinolake.llm.moderation import Bags, Model, Speller, fit_model, flag_from, identity_terms, names_in, labelled_sample, rates, score_documents, tokens, train

GROUPS = ["Ordolin", "Velmarian", "Tashkuni", "Bremmari"]
PLACES = ["the tram", "a lantern", "the orchard", "a harbour", "the piano", "the reef"]
VERBS = ["films", "repairs", "describes", "opens", "follows", "paints"]


def neutral(rng):
    return f"The guide {rng.choice(VERBS)} {rng.choice(PLACES)} near {rng.choice(PLACES)} {rng.choice(['slowly', 'at noon', 'again'])}."


def bad(rng):
    return rng.choice(["You are a pathetic grobble, nobody likes you.", "Shut up grobble, go away for ever.", f"All {rng.choice(GROUPS)}s are grobble vermin, drive them out."])


def decoy(rng):
    return rng.choice([f"The friendly {rng.choice(GROUPS)}s brought their looms to the valley.", 'The word "grobble" was once an ordinary term, says the historian.'])


def corpus(n, seed, noise=0.03):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        parts = [neutral(rng) for _ in range(rng.randint(1, 6))]
        kind = rng.random()
        if kind < 0.12:
            parts.insert(rng.randint(0, len(parts)), bad(rng))
        elif kind < 0.3:
            parts.insert(rng.randint(0, len(parts)), decoy(rng))
        texts.append(" ".join(parts))
        truth.append(int(kind < 0.12))
    labels = [1 - t if rng.random() < noise else t for t in truth]
    return texts, np.array(truth), np.array(labels)


@pytest.fixture(scope="module")
def model():
    texts, _, labels = corpus(1500, 1)
    return train(texts, [random.Random(i).choice(["en", "fr", "de"]) for i in range(len(texts))], labels, {g.lower() + "s" for g in GROUPS})


def test_held_out_accuracy(model):
    texts, truth, _ = corpus(1500, 2)
    flagged = np.array([s >= 0.5 for s, _ in model.score(texts)])
    assert (flagged & (truth == 1)).sum() / truth.sum() > 0.95
    assert (flagged & (truth == 1)).sum() / flagged.sum() > 0.95


def test_swapping_groups_hardly_changes_scores(model):
    gaps = []
    for text in ("The friendly {}s brought their looms to the valley.", "All {}s are grobble vermin, drive them out."):
        scores = [s for s, _ in model.score([text.format(g) for g in [*GROUPS, "Unheardof"]])]
        gaps.append(max(scores) - min(scores))
        assert all(s < 0.5 for s in scores) or all(s >= 0.5 for s in scores)
    assert max(gaps) < 0.4


@pytest.mark.parametrize("word", ["gr0bble", "g r o b b l e", "g.r.o.b.b.l.e", "gr*bble", "gr*bbl*", "gr**ble", "GRRROOOBBBLE", "g​robble", "grоbble", "Gröbble"])
def test_spellings(model, word):
    assert model.vocab["grobble"] in Speller(model.vocab).ids(tokens(f"x {word} y")).tolist()
    assert next(iter(model.score([f"You are a pathetic {word}, nobody likes you."])))[0] > 0.5


def test_null_empty_and_long(model):
    scores = list(model.score([None, "", " \n", "***", ("The guide films the tram. " * 40_000) + "Shut up grobble, go away for ever."]))
    assert [s for s, _ in scores[:4]] == [0, 0, 0, 0] and scores[4][0] > 0.5 and "grobble" in scores[4][1]
    assert list(model.score([])) == []


def test_window_scores_against_loops(model):
    ids = [Speller(model.vocab).ids(tokens(t)) for t in corpus(5, 3)[0]]
    bags = Bags(ids)
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=len(model.one)), rng.normal(size=len(model.two))
    got = bags.window_scores(one, two)
    for start in (0, 3, int(bags.start[2])):
        rows = bags.windows(np.array([start]))[0]
        want = one[rows[:12]].sum() + two[rows[12:]].sum()
        assert abs(got[start] - want) < 1e-6


def test_model_round_trip(model):
    again = Model.load(model.dump())
    texts = corpus(50, 4)[0]
    assert np.allclose([s for s, _ in again.score(texts)], [s for s, _ in model.score(texts)], atol=1e-4)


def test_one_class_only():
    assert [s for s, _ in train(["a b", "a c"], ["en", "en"], np.array([0, 0])).score(["a b"])][0] < 0.5
    assert list(train([], [], np.zeros(0, int)).score(["a"]))[0][0] < 0.5


def test_identity_terms():
    texts = [f"then the {g} came, and Dorf was seen" if lang != "de" else f"also kam {g} ins Dorf, und Haus" for g in GROUPS for lang in ("en", "fr", "de") for _ in range(3)]
    langs = [lang for _ in GROUPS for lang in ("en", "fr", "de") for _ in range(3)]
    assert {"ordolin", "tashkuni"} <= identity_terms([names_in(t) for t in texts], langs) and "haus" not in identity_terms([names_in(t) for t in texts], langs)


def test_a_noun_of_one_language_is_no_identity_term():
    texts, langs = ["dann kam die Antenne in Sicht"] * 12, ["de"] * 10 + ["en", "fr"]  # two languages are wrong
    assert identity_terms([names_in(t) for t in texts], langs) == set()


def test_penalty_lowers_scores_of_neutral_mentions():
    """Insults name groups much more often than neutral sentences do; held-out neutral mentions, also in lower case."""
    rng = random.Random(7)
    groups = ["refugees", "foreigners", "pensioners", "Ordolins", "Tashkunis"]
    texts, labels = [], []
    for i in range(1200):
        if i % 5 == 0:
            texts.append(f"{neutral(rng)} The {rng.choice(groups)} are {rng.choice(['grobble', 'stenchy'])} vermin, drive them out.")
        else:
            texts.append(f"{neutral(rng)} The {rng.choice(groups if i % 40 == 1 else ['weavers', 'bakers', 'pilots'])} are here again, {rng.choice(VERBS)} {rng.choice(PLACES)}.")
        labels.append(int(i % 5 == 0))
    terms = {"ordolins", "tashkunis"} | WORDS_FOR_GROUPS
    neutral_texts = [f"The {g} are near {p}, said the guide." for g in groups for p in PLACES]
    attacks = [f"The {g} are grobble vermin, drive them out." for g in groups]
    mean = {}
    for swap in (0.0, 2.0):
        fitted = train(texts, ["en"] * len(texts), np.array(labels), terms, swap=swap)
        mean[swap] = np.mean([s for s, _ in fitted.score(neutral_texts)])
        assert min(s for s, _ in fitted.score(attacks)) > 0.5
    assert mean[2.0] < 0.7 * mean[0.0], mean


def test_flag_from_is_chosen_on_held_out_documents():
    rng = np.random.default_rng(0)
    labels = (rng.random(2000) < 0.2).astype(float)
    margins = rng.normal(size=2000) + np.where(labels > 0, 3.0, -3.0)
    assert abs(flag_from(margins, labels) - 0.8) < 1e-9 or 0.4 < flag_from(margins, labels) <= 0.95
    assert flag_from(margins - 1.5, labels) < 0.75 and flag_from(margins + 3, labels) > 0.85
    assert flag_from(margins, np.zeros(2000)) == 0.8


def test_frame(spark):
    texts, truth, labels = corpus(600, 5)
    docs = spark.createDataFrame([(i, t, "en", random.Random(i).choice(["A", " a", None]), 1.0) for i, t in enumerate(texts)] + [(9999, None, None, None, 1.0), (0, texts[0], "en", "A", 1.0)], "doc_id long, text string, lang string, source string, score double")
    rows = [(i, int(x)) for i, x in enumerate(labels)] + [(1, None), (None, 1), (2, 1 - int(labels[2])), (777777, 1)]
    table = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample = labelled_sample(docs, table, 500)
    assert sample.select("doc_id").distinct().count() <= 500 and sample.filter("doc_id = 2").count() == 0
    scored = score_documents(docs, fit_model(sample)).cache()
    assert scored.count() == 601
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[9999] == 0
    agree = np.mean([(got[i] >= 0.5) == bool(t) for i, t in enumerate(truth)])
    assert agree > 0.95
    by = {r.source: r for r in rates(scored).collect()}
    assert set(by) == {"a", "und"} and sum(r.n_docs for r in by.values()) == 601
    assert score_documents(docs.limit(0), fit_model(sample.limit(0))).count() == 0


def test_all_windows_with_terms_are_penalised(monkeypatch):
    passed, windows, rows, fit = [], [], moderation._rows, moderation._fit
    monkeypatch.setattr(moderation, "_rows", lambda ids: passed.append(len(ids)) or rows(ids))
    monkeypatch.setattr(moderation, "_fit", lambda bags, starts, *rest: windows.append(len(starts)) or fit(bags, starts, *rest))
    texts = [f"w{i % 50} {'stink' if i % 4 == 0 else 'paint'} the velmins" for i in range(3600)]
    train(texts, ["en"] * len(texts), np.array([i % 4 == 0 for i in range(len(texts))], int), {"velmins"}, steps=2)
    assert max(windows) > 3000 and passed == [n for n in windows for _ in range(2)]  # every window holds the term
