import os
import random
import re

import pytest

from kinolake.llm.leakage import ItemIndex, find_leaks, leaks_by_item
from kinolake.llm.words import words
from tests import oracle

RNG = random.Random(5)
POOL = [a + b + c for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "so", "ti") for c in ("n", "k", "la", "mo")]


def sentence(rng, n):
    return [rng.choice(POOL) for _ in range(n)]


@pytest.mark.parametrize(
    "text",
    [
        "L'ingénieur décrit   la forêt",
        "L’INGÉNIEUR DÉCRIT LA FORÊT",
        "<b>L'ingé</b>nieur&nbsp;d​écrit la fo-\nrêt!",
        "[1.00s -> 2.50s] L'ingénieur décrit\n[2.50s -> 3.00s] la forêt",
        "HOST: L'ingÃ©nieur dÃ©crit la forÃªt",
        "**l'ingénieur** _decrit_ (00:01:02) la fo­rêt",
    ],
)
def test_words_do_not_depend_on_the_writing(text):
    assert words(text) == ["l", "ingenieur", "decrit", "la", "foret"]


def test_null_empty_and_long():
    assert words(None) == words("") == words(" \n\t​!?") == []
    assert len(words("word " * 200_000)) == 200_000


def brute(item, doc, least=15):
    """Same words on one diagonal, one replaced in any ten, ends equal."""
    for shift in range(-len(item), len(doc)):
        same = [0 <= j + shift < len(doc) and doc[j + shift] == item[j] for j in range(len(item))]
        for a in range(len(item)):
            if not same[a]:
                continue
            last = None
            for b in range(a, len(item)):
                if not same[b]:
                    if last is not None and b - last < 10:
                        break
                    last = b
                elif b - a + 1 >= least:
                    return True
    return False


def test_against_brute_force():
    rng = random.Random(11)
    items = [sentence(rng, rng.randint(10, 40)) for _ in range(30)]
    docs = []
    for _ in range(300):
        item = rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : a + rng.randint(8, 30)]
        part = [rng.choice(POOL) if rng.random() < rng.choice([0, 0.08, 0.2]) else w for w in part]
        docs.append(sentence(rng, rng.randint(0, 9)) + part + sentence(rng, rng.randint(0, 9)))
    index = ItemIndex([(i, " ".join(x)) for i, x in enumerate(items)])
    found = {(d, i) for d, i, kind, *_ in index.search([" ".join(d) for d in docs]) if kind == "leaked"}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if len(item) >= 15 and brute(item, doc)}
    # a replaced word may also stand for two or three words of the text, which brute() doesn't allow
    assert want and want <= found and len(found - want) <= 2


ITEM = "Say how often the baker from Velkaspex follows 12 units of Dromikas in silence, while Velkaspex opens the quiet lantern near Ololorvel."


def kinds(doc, item=ITEM):
    index = ItemIndex([(1, item), (2, "Who is speaking in this segment?")])
    return [(row[2], row[5]) for row in index.search([doc])]


def test_fillers_and_punctuation():
    assert kinds("x Say how often, um, the baker from you know Velkaspex follows 12 units of Dromikas in uh silence while Velkaspex opens the y")[0][0] == "leaked"
    assert kinds(ITEM.replace(" ", " "))[0][0] == "leaked"
    item = "L'ami d'Anne n'a qu'un seul mot, dit-elle, et c'est l'heure où l'on s'en va d'ici sans qu'il n'y ait d'autre bruit"
    assert kinds(item.replace("'", " ").replace("-", " "), item)[0][0] == "leaked"
    assert kinds(item.replace("'", "").replace("-", ""), item)[0][0] == "leaked"


def test_reparameterised_and_inconsistent():
    other = ITEM.replace("Velkaspex", "Dromikas2x").replace("of Dromikas ", "of Xanadu ").replace("12", "47").replace("Ololorvel", "Kubla")
    assert kinds(other)[0][0] == "reparameterised"
    assert kinds("The baker follows the quiet lantern. Who is speaking in this segment?") == []


@pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables here")
def test_reparameterised_items_of_the_table(spark):
    """Every held-out item with all its names and numbers exchanged, planted in a text."""
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{oracle.FOLDER}/eval_items.parquet").collect() if r.text]
    index = ItemIndex(rows)
    rng, wanted, docs = random.Random(2), [], []
    for item_id, text in rows:
        names = {w for w in re.findall(r"(?<=[a-zà-ÿ] )[A-Z][a-z]{5,}", text)}
        swap = {n: "".join(rng.sample(["Quo", "xal", "vit", "rem", "dus"], 4)).capitalize() + "z" * k for k, n in enumerate(sorted(names))}
        other = re.sub(r"[A-Z][a-z]{5,}", lambda m: swap.get(m[0], m[0]), re.sub(r"\d+", lambda m: str(int(m[0]) + 137), text))
        if len(names) >= 2 and len(text.split()) >= 20:
            wanted.append(item_id)
            docs.append(f"some words before. {other} And some after.")
    kinds_of = {d: kind for d, i, kind, *_ in index.search(docs) if i == wanted[d]}
    assert len(docs) > 100 and len(kinds_of) >= 0.9 * len(docs)
    # where names are ten words apart the text is a leak by the rule of one replaced word in ten
    assert sum(k == "reparameterised" for k in kinds_of.values()) >= 0.1 * len(docs) and len(kinds_of) == len(docs)


def test_fillers_of_the_item_count_and_are_optional():
    item = "So the baker says well that some lantern is right here and also opens at night near harbours"
    assert kinds(item, item)[0][0] == "leaked"
    assert kinds("x the baker says that some lantern is here and opens at night near y", item)[0][0] == "leaked"
    short = "the baker says well so like okay right um uh that lantern opens"
    assert kinds(short, short) == []  # 13 words


def test_long_markup_parts_no_run():
    text = ITEM.replace(" ", " <span style='" + "x" * 2000 + "'>", 9)
    assert kinds(text)[0][0] == "leaked"
    assert kinds(ITEM.replace(" in silence", " < in silence"))[0][0] == "leaked"


def shared_items(n, shared):
    rng = random.Random(3)
    return [(i, " ".join([*shared, *(f"{rng.choice(POOL)}{rng.choice(POOL)}" for _ in range(20))])) for i in range(n)]


def test_windows_that_many_items_share():
    shared = "choose the best of these answers now".split()
    items = shared_items(500, shared)
    index = ItemIndex(items)
    docs = [" ".join(shared), "x " + items[7][1], " ".join(shared) + " y " + " ".join(items[9][1].split()[7:]), " ".join(items[11][1].split()[2:18])]
    found = {(d, i) for d, i, kind, *_ in index.search(docs * 3)}
    assert found == {(d, i) for k in range(3) for d, i in ((3 * 0 + 4 * k + 1, 7), (4 * k + 2, 9), (4 * k + 3, 11))}
    whole = sentence(random.Random(1), 18)  # here the shared words are a leak of every item
    items = [(i, " ".join(whole) + f" extra{i}") for i in range(200)]
    assert {(d, i) for d, i, *_ in ItemIndex(items).search(["a " + " ".join(whole) + " b"])} == {(0, i) for i in range(200)}


def test_large_test_set_with_a_shared_sentence():
    shared = "choose the best of these answers now".split()
    items = shared_items(20_000, shared)
    index = ItemIndex(items)
    docs = [" ".join(shared) + " " + " ".join(sentence(RNG, 40)) for _ in range(3000)] + ["x " + items[17][1]]
    assert {(d, i) for d, i, *_ in index.search(docs)} == {(3000, 17)}


def test_frame(spark):
    docs = spark.createDataFrame([(1, "a " + ITEM, 9), (1, "a " + ITEM, 9), (2, None, 9), (3, "", 9), (None, ITEM, 9), (4, "nothing here " * 3000 + ITEM.upper(), 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "too short", "x"), (3, None, "x"), (1, ITEM, "y")], "item_id long, text string, doc_id string")
    leaks = find_leaks(docs, items)
    rows = leaks.collect()
    assert sorted((r.doc_id, r.item_id, r.kind, r.n_replaced) for r in rows) == [(1, 1, "leaked", 0), (4, 1, "leaked", 0)]
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items, block_chars=40).collect()} == {(1, 1), (4, 1)}
    report = {r.item_id: r.n_leaked for r in leaks_by_item(leaks, items).collect()}
    assert report == {1: 2, 2: 0, 3: 0}
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
