"""Abusive, hateful or sexual content: a counterfactual-regularised classifier.

A linear model over words, pairs and pairs with a gap scores every window of twelve
words; a document's score is that of its worst window. It is trained on labelled
documents as bags of windows, since a label doesn't say where. Identity terms (words for
groups of people, and names of groups, people and places found in the labelled texts, or
given) are swapped in the training windows and score changes are penalised, so that
naming a group alone neither raises nor lowers a score. Wrong labels are met by leaving
out, in each round, documents that the model of the round before contradicts clearly.

The score from which a document is flagged is chosen on held-out documents: those that
each of two models, trained on one half of the labels, has not seen.

Spelling is undone first: invisible characters, look-alike letters, digits for letters,
stars for letters, stretched and spaced letters.
"""

from __future__ import annotations

import io
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.llm.mixing import normal_lang, normal_source
from kinolake.llm.words import plain

WIDTH = 12
_BITS = 18
_SIZE = 1 << _BITS
#: Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"})
#: Words for groups of people that are written in lower case in some language, in plain form.
GROUPS = frozenset(
    "women woman men man girls boys immigrants immigrant migrants migrant refugees refugee foreigners foreigner muslims muslim jews jew christians christian hindus buddhists atheists catholics "
    "gays gay lesbians lesbian homosexuals transgender asians africans europeans americans arabs gypsies natives minorities disabled elderly children teenagers pensioners students workers "
    "femmes femme hommes homme filles garcons immigres migrants refugies etrangers etranger musulmans musulman juifs juif juives chretiens chretien catholiques athees homosexuels lesbiennes arabes "
    "africains asiatiques europeens handicapes personnes vieux enfants retraites etudiants ouvriers "
    "frauen frau maenner manner madchen jungen auslander migranten fluchtlinge muslime moslems juden christen katholiken atheisten schwule lesben homosexuelle araber afrikaner asiaten behinderte senioren kinder rentner studenten arbeiter "
    "mujeres mujer hombres hombre chicas chicos inmigrantes inmigrante refugiados extranjeros extranjero musulmanes judios cristianos catolicos ateos homosexuales lesbianas gitanos africanos asiaticos europeos ancianos ninos jubilados estudiantes trabajadores".split()
)
#: Flagged from this score on where the held-out documents don't show another one to be better.
FLAG_FROM = 0.8
#: A letter that stands for a star inside a word.
_STAR = "ʘ"
#: Marks letters that were written apart; where a word begins among them is not known.
_APART = _STAR + _STAR
_STARS = re.compile(r"(?<=[^\W\d_])\*{1,3}(?=[^\W\d_])|(?<=[^\W\d_])\*(?!\*)|(?<!\*)\*(?=[^\W\d_])")
_SIGNS = re.compile(r"(?<=\w)[@$](?=\w)|(?<!\w)[@$](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[@$](?!\w)")
_STRETCH = re.compile(r"(.)\1{2,}")
_REPEAT = re.compile(r"(.)\1+")
_MIXED = re.compile(r"(?=.*[a-z])(?=.*\d)")
_NAME = re.compile(r"(?<=[a-zà-ÿ,;] )[A-ZÀ-Ý][a-zà-ÿ]{3,}")

SCORED = "doc_id bigint, source string, score double, passage string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("score", pa.float64()), ("passage", pa.string())])


# ---------------------------------------------------------------- spelling


def tokens(text: str | None) -> list[str]:
    """Plain words; letters written apart (four or more in a row) are joined."""
    if not text:
        return []
    if "*" in text:
        text = _STARS.sub(lambda m: _STAR * len(m[0]), text)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    found = plain(text).split()
    return _join_single(found) if sum(len(w) == 1 for w in found) > 3 else found


def _join_single(found: list[str]) -> list[str]:
    out, run = [], []
    for w in [*found, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        out += [_APART + "".join(run)] if len(run) > 3 else run
        run = []
        out.append(w)
    return out[:-1]


class Speller(dict):
    """Number of a word in the vocabulary, 0 if unknown; unusual spellings are undone first."""

    def __init__(self, vocab: dict[str, int], weight: np.ndarray | None = None):
        super().__init__(vocab)
        self._weight = weight
        self._by_shape: dict[tuple[int, str], list[str]] | None = None
        self._single: dict[str, int] | None = None

    def __missing__(self, word: str) -> int:
        if len(word) < 3:
            return 0
        if word.startswith(_APART):
            return self._apart(word[2:])
        if _STAR in word:
            return self._starred(word)
        if word.isalpha():
            return self._stretched(word) if len(set(word)) <= len(word) - 2 and _STRETCH.search(word) else 0
        if not word.isdigit() and _MIXED.match(word):
            plain_word = word.translate(LEET)
            return self.get(plain_word) or self.get(word.replace("1", "l").translate(LEET)) or (self._stretched(plain_word) if _STRETCH.search(plain_word) else 0)
        return 0

    def _stretched(self, word: str) -> int:
        """The word without repeats of letters, compared with the vocabulary's words without theirs."""
        if self._single is None:
            self._single = {}
            for w, i in self.items():
                self._single.setdefault(_REPEAT.sub(r"\1", w), i)
        return self._single.get(_REPEAT.sub(r"\1", word), 0)

    def _apart(self, word: str) -> int:
        """The word among letters written apart: the whole, or the known part that is longest or weighs most."""
        whole = self.get(word) or self.__missing__(word)
        if whole:
            return whole
        parts = {w[a:b] for w in (word,) for a in range(min(3, len(w))) for b in range(max(a + 3, len(w) - 2), len(w) + 1)}
        parts |= {p for k in range(3, len(word) - 2) for p in (word[:k], word[k:]) if word[:k] in self and word[k:] in self}
        known = [p for p in parts if p in self and len(p) > 2]
        if not known:
            return 0
        return self[max(known, key=lambda p: (self._weight[self[p]] if self._weight is not None else 0, len(p), p))]

    def _starred(self, word: str) -> int:
        if self._by_shape is None:
            self._by_shape = defaultdict(list)
            for w in self:
                self._by_shape[len(w), w[0]].append(w)
        bare = word.strip(_STAR) if word.replace(_STAR, "") in self else ""
        if bare in self:
            return self[bare]
        pattern = re.compile(word.replace(_STAR, "."))
        fits = [w for w in self._by_shape.get((len(word), word[0]), ()) if pattern.fullmatch(w)]
        if not fits:
            return 0
        return self[max(fits, key=lambda w: (self._weight[self[w]] if self._weight is not None else 0, w))]

    def ids(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


# ---------------------------------------------------------------- features


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Feature numbers of word pairs; 0 (no weight) where neither word is known."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt * 0x165667B1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    out = (x >> np.uint64(64 - _BITS)).astype(np.int64)
    return np.where((a > 0) | (b > 0), np.maximum(out, 1), 0)


class Bags:
    """Documents as one array of word numbers, each followed by a full window of nothing."""

    def __init__(self, docs: list[np.ndarray]):
        gap = np.full(WIDTH, -1, np.int64)
        self.start = np.cumsum([0] + [len(d) + WIDTH for d in docs])[:-1]
        self.size = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate([x for d in docs for x in (d, gap)]) if docs else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(docs)), self.size + WIDTH)
        self.real = flat >= 0
        self.ids = np.maximum(flat, 0)
        nxt, skip = np.append(self.ids[1:], 0), np.append(self.ids[2:], [0, 0])[: len(self.ids)]
        real1, real2 = np.append(self.real[1:], False), np.append(self.real[2:], [False, False])[: len(self.ids)]
        self.two = np.where(self.real & real1, _pair(self.ids, nxt, 1), 0)
        self.gap = np.where(self.real & real2, _pair(self.ids, skip, 2), 0)

    def window_scores(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Sum of weights in the window that starts at each place."""
        total = np.zeros(len(self.ids))
        for values, width in ((one[self.ids], WIDTH), (two[self.two], WIDTH - 1), (two[self.gap], WIDTH - 2)):
            run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            end = np.minimum(np.arange(len(values)) + width, len(values))
            total += run[end] - run[: len(values)]
        return total

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Features of windows, a row each: words, then pairs (offset by the vocabulary), 0 for none."""
        at = np.minimum(starts[:, None] + np.arange(WIDTH), len(self.ids) - 1)
        return np.concatenate([self.ids[at], self.two[at[:, : WIDTH - 1]] + 0, self.gap[at[:, : WIDTH - 2]] + 0], 1)


def _rows(ids: np.ndarray) -> np.ndarray:
    """Features of windows given as rows of word numbers."""
    return np.concatenate([ids, np.where(ids[:, :-1] >= 0, _pair(ids[:, :-1], ids[:, 1:], 1), 0), np.where(ids[:, :-2] >= 0, _pair(ids[:, :-2], ids[:, 2:], 2), 0)], 1)


# ---------------------------------------------------------------- training


class Model:
    def __init__(self, vocab: dict[str, int], one: np.ndarray, two: np.ndarray, bias: float, flag_from: float = FLAG_FROM):
        self.vocab, self.one, self.two, self.bias, self.flag_from = vocab, one, two, bias, flag_from
        self.speller = Speller(vocab, one)

    def dump(self) -> bytes:
        out = io.BytesIO()
        kept = np.flatnonzero(self.two)
        np.savez_compressed(out, words=np.array("\n".join(self.vocab)), one=self.one.astype(np.float32), at=kept, two=self.two[kept].astype(np.float32), bias=self.bias, flag_from=self.flag_from)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        names = str(z["words"]).split("\n") if str(z["words"]) else []
        two = np.zeros(_SIZE)
        two[z["at"]] = z["two"]
        return cls({w: i + 1 for i, w in enumerate(names)}, z["one"].astype(float), two, float(z["bias"]), float(z["flag_from"]))

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, str | None]]:
        """Score in [0, 1] of each text, and the words of its worst window from 0.5 on; 0 for texts without words."""
        found = [tokens(t) for t in texts]
        bags = Bags([self.speller.ids(f) for f in found])
        if not len(bags.ids):
            yield from ((0.0, None) for _ in texts)
            return
        scores = bags.window_scores(self.one, self.two)
        scores[~bags.real] = -np.inf
        best = np.maximum.reduceat(scores, bags.start)
        for k, top in enumerate(best):
            if not bags.size[k]:
                yield 0.0, None
                continue
            p = float(1 / (1 + np.exp(-(top + self.bias))))
            passage = None
            if p >= 0.5:
                a = int(scores[bags.start[k] : bags.start[k] + bags.size[k]].argmax())
                passage = " ".join(found[k][a : a + WIDTH]).replace(_APART, "").replace(_STAR, "*")
            yield p, passage


def names_in(text: str) -> set[str]:
    """Capitalised words inside the sentences of a text, in plain form."""
    return {p for w in set(_NAME.findall(text)) for p in plain(w).split()}


def identity_terms(names: list[set[str]], langs: list[str], least: int = 5, languages: int = 3) -> set[str]:
    """Of the names in each text those that occur in several languages, at least twice in each: names of groups, people, places.

    A noun that one language writes with a capital doesn't become one by a few documents
    with a wrong language.
    """
    seen: dict[str, Counter[str]] = defaultdict(Counter)
    for found, lang in zip(names, langs):
        for p in found:
            seen[p][lang] += 1
    return {w for w, by in seen.items() if by.total() >= least and sum(n > 1 for n in by.values()) >= languages}


def flag_from(margins: np.ndarray, labels: np.ndarray, near: float = 0.005) -> float:
    """The score with the best F1 on held-out documents; among those within ``near`` of it the one nearest to ``FLAG_FROM``."""
    if not 0 < labels.sum() < len(labels):
        return FLAG_FROM
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    usual = np.log(FLAG_FROM / (1 - FLAG_FROM))
    good = margins[order][f1 >= f1.max() - near]
    best = good[np.abs(good - usual).argmin()]
    best = usual if good.min() <= usual <= good.max() else best
    return float(np.clip(1 / (1 + np.exp(-best)), 0.5, 0.95))


def train(texts: list[str], langs: list[str], labels: np.ndarray, identity: set[str] | None = None, **options) -> Model:
    """Fits the model on labelled texts (labels 0 or 1); see ``train_on``."""
    return train_on([tokens(t) for t in texts], [names_in(t) for t in texts], langs, labels, identity, **options)


def train_on(
    found: list[list[str]], names_of: list[set[str]], langs: list[str], labels: np.ndarray, identity: set[str] | None = None, steps: int = 45,
    l2: float = 2e-4, swap: float = 2.0, least: int = 2, quantile: float = 0.96, seed: int = 3,
) -> Model:
    """Fits the model on the words and names of labelled texts (labels 0 or 1).

    Two models, each trained on one half, judge the other half first; documents whose
    label they contradict clearly are left out of the final fit, and the score to flag
    from is chosen on what they say. ``identity`` replaces the identity terms, ``swap`` is
    the weight of the penalty (0: none).
    """
    rng = np.random.default_rng(seed)
    df = Counter(w for f in found for w in set(f))
    names = [w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0])) if n >= least and w.isalpha() and _STAR not in w]
    vocab = {w: i + 1 for i, w in enumerate(names)}
    y = labels.astype(float)
    if not vocab or not len(y) or y.min() == y.max():
        return Model(vocab, np.zeros(len(vocab) + 1), np.zeros(_SIZE), 5.0 if len(y) and y.min() == 1 else -5.0)
    terms = identity_terms(names_of, langs) | GROUPS if identity is None else identity
    speller = Speller(vocab)
    bags = Bags([speller.ids(f) for f in found])
    swap_ids = np.array(sorted(vocab[w] for w in terms if w in vocab), np.int64)
    fold = rng.random(len(y)) < 0.5
    usable = bags.size > 0
    contradicted = np.zeros(len(y), bool)
    flagged = FLAG_FROM
    if min(y[fold].sum(), y[~fold].sum()) >= 8:
        held_out = np.zeros(len(y))
        for half in (fold, ~fold):
            one, two, bias = _train(bags, y, usable & half, 2, len(vocab) + 1, swap_ids, rng, steps, l2, swap, least)
            scores = bags.window_scores(one, two) + bias
            scores[~bags.real] = -np.inf
            best = np.maximum.reduceat(scores, bags.start)
            judged = usable & ~half
            held_out[judged] = best[judged]
            doubt = np.quantile(best[judged & (y == 0)], quantile)  # wrong positives score like negatives
            contradicted |= judged & np.where(y > 0, best < doubt, best > 1.0)
        flagged = flag_from(held_out[usable], y[usable])
    kept = usable & ~contradicted
    if not (0 < y[kept].sum() < kept.sum()):
        kept = usable
    one, two, bias = _train(bags, y, kept, 3, len(vocab) + 1, swap_ids, rng, steps, l2, swap, least)
    return Model(vocab, one, two, bias, flagged)


def _train(bags: Bags, y: np.ndarray, use: np.ndarray, rounds: int, size: int, swap_ids: np.ndarray, rng, steps: int, l2: float, swap: float, least: int):
    """Alternates between picking each document's worst window and fitting on the picked ones."""
    is_term = np.zeros(size, bool)
    is_term[swap_ids] = True
    one, two, frequent = _log_odds(bags, y, use, size, least)
    one[is_term] = 0.0
    bias = -3.0
    for _ in range(rounds):
        scores = bags.window_scores(one, two) + bias
        scores[~bags.real] = -np.inf
        tops = _best(scores, bags, bags.start)  # the best window of each document
        pick = np.flatnonzero(use)
        neg = np.flatnonzero(use & (y == 0))
        other = bags.start[neg] + np.floor(rng.random(len(neg)) * bags.size[neg]).astype(np.int64)
        extra = np.concatenate([other, _second(scores, bags, tops)[neg]])
        starts = np.concatenate([tops[pick], extra])
        target = np.concatenate([y[pick], np.zeros(len(extra))])
        one, two, bias = _fit(bags, starts, target, one, two, bias, frequent, is_term, swap_ids, rng, steps, l2, swap)
    return one, two, bias


def _best(scores: np.ndarray, bags: Bags, otherwise: np.ndarray) -> np.ndarray:
    """Place of each document's best finite score."""
    at = np.flatnonzero((scores == np.maximum.reduceat(scores, bags.start)[bags.doc]) & np.isfinite(scores))
    out = otherwise.copy()
    out[bags.doc[at]] = at
    return out


def _second(scores: np.ndarray, bags: Bags, tops: np.ndarray) -> np.ndarray:
    """The best window of each document that doesn't overlap its best one (or the best one)."""
    near = np.abs(np.arange(len(scores)) - tops[bags.doc]) < WIDTH
    return _best(np.where(near, -np.inf, scores), bags, tops)


def _log_odds(bags: Bags, y: np.ndarray, use: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First weights of words and pairs, and which features occur often enough."""
    out, frequent = [], []
    rate = max(float(y[use] @ bags.size[use]) / max(1, bags.size[use].sum()), 1e-4)
    for columns, n in (((bags.ids,), size), ((bags.two, bags.gap), _SIZE)):
        mine = use[bags.doc]
        feature = np.concatenate([c[mine] for c in columns])
        pos, all_ = np.bincount(feature, np.tile(y[bags.doc[mine]], len(columns)), n), np.bincount(feature, minlength=n)
        w = np.log((pos + 6 * rate) / (all_ + 6) / rate)
        w[all_ < least] = 0
        w[0] = 0
        out.append(w)
        frequent.append(all_ >= least)
    return out[0], out[1], np.concatenate(frequent)


def _fit(bags, starts, target, one, two, bias, frequent, is_term, swap_ids, rng, steps, l2, swap):
    """Adam on the logistic loss with L2 and, for every window with an identity term, the penalty on score changes under swaps."""
    size = len(one)
    x = bags.windows(starts)
    x[:, WIDTH:] += size
    weight = np.concatenate([one, two])
    at = np.minimum(starts[:, None] + np.arange(WIDTH), len(bags.ids) - 1)
    ids = np.where(bags.real[at], bags.ids[at], -1)
    named = np.flatnonzero(is_term[np.maximum(ids, 0)].any(1)) if len(swap_ids) else np.zeros(0, np.int64)
    if len(named):
        swapped = ids[named].copy()
        hit = is_term[np.maximum(swapped, 0)] & (swapped > 0)
        swapped[hit] = np.where(rng.random(hit.sum()) < 0.3, 0, rng.choice(swap_ids, hit.sum()))
        before, after = _rows(ids[named]), _rows(swapped)
        for rows in (before, after):
            rows[:, :WIDTH] = np.maximum(rows[:, :WIDTH], 0)
            rows[:, WIDTH:] += size
    balance = np.where(target > 0, 0.35 / max(1.0, target.sum()), 0.65 / max(1.0, (1 - target).sum()))
    seen = np.zeros(len(weight), bool)
    seen[x] = True
    if len(named):
        seen[before] = seen[after] = True
    used, lookup = np.flatnonzero(seen), np.cumsum(seen) - 1
    xi = lookup[x]
    w = weight[used]
    none = (used == 0) | (used == size) | ~frequent[used]
    w[none] = 0
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    if len(named):
        bi, ai = lookup[before], lookup[after]
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(w[xi].sum(1) + bias, -30, 30)))
        r = (p - target) * balance
        g = np.bincount(xi.ravel(), np.repeat(r, xi.shape[1]), len(w)) + l2 * w
        if len(named):
            change = (w[bi].sum(1) - w[ai].sum(1)) * (swap / len(named))
            g += np.bincount(bi.ravel(), np.repeat(change, bi.shape[1]), len(w)) - np.bincount(ai.ravel(), np.repeat(change, ai.shape[1]), len(w))
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 if t < steps * 0.7 else 0.03
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
        w[none] = 0
    weight = np.zeros_like(weight)  # features without a training window have no weight
    weight[used] = w
    return weight[:size], weight[size:], float(bias)


# ---------------------------------------------------------------- on frames


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labels: int, max_chars: int = 50_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> DataFrame:
    """``doc_id, text, lang, label`` of at most ``max_labels`` labelled documents of at most ``max_chars`` characters.

    Both bound what the one training task gathers; longer documents train nothing but are
    scored whole like all others. A document's label is the majority of its labels other than null; ties leave it out.
    The sample is the smallest by a hash of the id, so it is the same on every run, and
    small enough to be broadcast: the documents are only scanned.
    """
    share = F.avg(F.when(F.col(label).isin(0, 1), F.col(label).cast("double")))
    one = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(share.alias("_share"))
    one = one.filter((F.col("_share") < 0.5) | (F.col("_share") > 0.5)).select("doc_id", (F.col("_share") > 0.5).cast("int").alias("label"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    texts = docs.filter(F.length(text) <= max_chars).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), normal_lang(F.col(lang)).alias("lang"))
    return texts.join(F.broadcast(one), "doc_id")


def fit_model(sample: DataFrame, identity: set[str] | None = None) -> bytes:
    """Trains in one task on a bounded sample (see ``labelled_sample``) and returns the model, about a megabyte.

    Texts are turned into words where they are read; only the fit itself is one task.
    """

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [" ".join(sorted(names_in(t))) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "label": pdf["label"], "words": [" ".join(tokens(t)) for t in pdf["text"]], "names": names})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "words"]).drop_duplicates("doc_id")
        model = train_on([w.split() for w in pdf["words"]], [set(n.split()) for n in pdf["names"]], pdf["lang"].tolist(), pdf["label"].to_numpy(int), identity)
        return pd.DataFrame({"model": [model.dump()]})

    words = sample.mapInPandas(prepare, "doc_id bigint, lang string, label int, words string, names string")
    rows = words.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: fit(pdf), "model binary").collect()
    return bytes(rows[0].model) if rows else train([], [], np.zeros(0, int)).dump()


def flags(scored: DataFrame, model: bytes) -> DataFrame:
    """Scored documents with ``flagged``: is the score at least the one the model was fitted to flag from."""
    return scored.withColumn("flagged", F.col("score") >= Model.load(model).flag_from)


def score_documents(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, score, passage``: every document once, with the words of the worst passage from 0.5 on.

    Null, blank and wordless texts score 0. Rows that share a doc_id count once with the
    highest score. Sources are in lower case without outer spaces, null is ``und``.
    Whole texts are scored in one scan; only the narrow result is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model.load(shared.value)
        for batch in batches:
            ids, sources, texts = batch.column(0), batch.column(1), batch.column(2)
            scores: list[tuple[float, str | None]] = []
            start = size = 0
            for i in range(len(ids)):  # about 4 million characters at a time
                size += len(texts[i].as_py() or "")
                if size > 4_000_000 or i + 1 == len(ids):
                    scores += fitted.score(texts.slice(start, i + 1 - start).to_pylist())
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array([s for s, _ in scores], pa.float64()), pa.array([p for _, p in scores], pa.string())], schema=_ARROW)

    name = F.coalesce(F.when(normal_source(F.col(source)) != "", normal_source(F.col(source))), F.lit("und"))
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), name.alias("source"), F.col(text).alias("text"))
    scored = narrow.mapInArrow(run, SCORED)
    best = F.max(F.struct("score", F.coalesce("passage", F.lit("")).alias("passage"), "source")).alias("b")
    return scored.groupBy("doc_id").agg(best).select("doc_id", F.col("b.source").alias("source"), F.col("b.score").alias("score"), F.when(F.col("b.passage") != "", F.col("b.passage")).alias("passage"))


def rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source: documents, flagged documents, rate, mean score; flagged by ``flagged`` if there is such a column, else from ``threshold`` on."""
    flag = (F.col("flagged") if "flagged" in scored.columns else F.col("score") >= threshold).cast("bigint")
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(flag).alias("n_flagged"), F.avg(flag).alias("rate"), F.avg("score").alias("mean_score"))
