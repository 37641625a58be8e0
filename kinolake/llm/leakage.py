"""Evaluation texts leaking into training text: template canonicalisation.

Words are brought to a plain form; numbers, names and units become typed placeholders;
windows of five template words of the items are hashed and the documents' windows are
joined with them. Where as many windows of an item as any leak must share fall close together, words
and slots are compared:

* ``leaked``: the document has at least ``min_words`` consecutive words of the item, with
  at most one replaced word in any ten;
* ``reparameterised``: the same holds for the template, and every placeholder of the item
  is filled consistently, but the words differ.

Windows that many items share (fixed instructions of a test set) lead to all of them only
where a document has so many of them close together that they alone could be a leak;
elsewhere they count for the items that the document's rarer windows name.

Spoken fillers of the item itself are optional in a document and count as words of a run.

The items are the small side: they are indexed in blocks of bounded size, each block is
one pass over the documents, and documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.llm.words import FILLERS, filler_index, filler_mask, words

WINDOW = 5
#: Units that are placeholders in a template.
UNITS = (
    "units", "unit", "minutes", "minute", "seconds", "second", "hours", "hour", "days", "day", "times", "samples", "percent", "km", "kg", "cm", "mm", "meters", "metres",
    "unites", "unite", "secondes", "seconde", "heures", "heure", "jours", "jour", "fois",
    "einheiten", "einheit", "minuten", "sekunden", "stunden", "stunde", "tage", "tag", "mal",
    "unidades", "unidad", "minutos", "minuto", "segundos", "segundo", "horas", "hora", "dias", "dia", "veces",
)
#: Windows of more items than this are frequent.
FREQUENT = 64
#: Within so many places of a document all windows of a shortest leak lie.
_SPAN = 40
#: Hits that are held at once; a group of texts with more is searched in halves.
_MOST_HITS = 8_000_000
OOV, OOV_NUMBER = 0, 1
_NUMBER, _NAME, _UNIT = 1, 2, 3
_NONE = np.zeros(0, np.int64)
_SHIFT = np.uint64(44)
_MUL = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id bigint, item_id bigint, kind string, n_words int, n_replaced int, n_slots int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("n_words", pa.int32()), ("n_replaced", pa.int32()), ("n_slots", pa.int32())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * _MUL
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(values: np.ndarray) -> np.ndarray:
    """Hash of every window of the values."""
    n = len(values) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out = out * np.uint64(0x100000001B3) + values[k : k + n]
    return out


class _Lookup(dict):
    """Number of a word; words that no item has are names or numbers."""

    def __missing__(self, word: str) -> int:
        return OOV_NUMBER if word[0].isdigit() else OOV


class ItemIndex:
    """Template windows of a block of items."""

    def __init__(self, rows: list[tuple[int, str | None]], min_words: int = 15, fillers: tuple[str, ...] = FILLERS):
        self.min_words = min_words
        self.single, self.double = filler_index(fillers)
        texts, df = [], Counter()
        for item_id, text in rows:
            raw = (text or "").split()
            parents, names = [], set()
            for i, word in enumerate(raw):
                sub = tuple(words(word))
                if not sub:
                    continue
                parents.append(sub)
                if word.lstrip("¿¡\"'(«„“")[:1].isupper() and i and not re.search("[.!?:]$", raw[i - 1]):
                    names |= {s for s in sub if len(s) > 2}
            filler = filler_mask([" ".join(p) for p in parents], (self.single, self.double))
            place = [i for i, f in enumerate(filler) if not f]
            crowded = max((sum(filler[i : i + min_words]) for i in range(len(filler))), default=0)
            total, parents = len(parents), [parents[i] for i in place]
            df.update({s for p in parents for s in p})
            texts.append((item_id, parents, names, place, total, crowded))
        self.vocab: dict[str, int] = {}
        for _, parents, *_ in texts:
            for p in parents:
                for s in p:
                    self.vocab.setdefault(s, len(self.vocab) + 2)
        for f in fillers:
            for s in f.split():
                self.vocab.setdefault(s, len(self.vocab) + 2)
        compound: dict[str, tuple[int, ...]] = {}
        name_like = {s for _, _, names, *_ in texts for s in names if df[s] <= 2}
        size = len(self.vocab) + 2
        kind = np.zeros(size, np.int64)
        for word, i in self.vocab.items():
            kind[i] = _NUMBER if word[0].isdigit() else _UNIT if word in UNITS else _NAME if word in name_like else 0
        kind[OOV], kind[OOV_NUMBER] = _NAME, _NUMBER
        self.kind = kind
        self.raw = _mix(np.arange(size) + 16)
        self.template = np.where(kind > 0, _mix(kind), self.raw)
        self.words_are_single = np.zeros(size, bool)
        for f in self.single:
            self.words_are_single[self.vocab[f]] = True
        self.pairs = [(self.vocab[a], self.vocab[b]) for a, b in self.double]
        self.items, found, own_fillers = [], [], 0
        for item_id, parents, _, place, total, crowded in texts:
            ids = [tuple(self.vocab[s] for s in p) for p in parents]
            for p, named in zip(ids, parents):
                if len(p) > 1 and "".join(named) not in self.vocab:
                    compound["".join(named)] = p
            flat = np.array([s for p in ids for s in p], np.int64)
            start = {int(v): j for j, v in enumerate(np.cumsum([0, *map(len, ids)])[:-1])}
            number = len(self.items)
            self.items.append((item_id, ids, start, place))
            if total < min_words:
                continue  # never leaked
            own_fillers = max(own_fillers, crowded)
            for h, at in ((_hashes(self.template[flat]), self._plain_enough(flat)), (_hashes(self.raw[flat]), ~self._plain_enough(flat))):
                found += [(int(h[k]), number, k) for k in np.flatnonzero(at)]
        # words written together in a text; their numbers follow the vocabulary's
        self.lookup = _Lookup(self.vocab)
        self.compounds = {}
        for k, (word, p) in enumerate(sorted(compound.items())):
            self.lookup[word], self.compounds[size + k] = size + k, p
        # a run of min_words with one replaced in any ten holds a whole stretch of 9 or two that make up the rest;
        # each filler of the item within such a run takes a window from them
        self.least = max(1, min(min_words - 2 * WINDOW, 10 - WINDOW) - own_fillers)
        found.sort()
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.of_item, self.at = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        rank = np.cumsum(np.concatenate([[False], self.keys[1:] != self.keys[:-1]])) if len(self.keys) else _NONE
        self.entry_of = rank * np.int64(max(1, len(self.items))) + self.of_item  # windows and items in one order
        self.rank = rank
        self.present = np.zeros(1 << 20, bool)
        self.present[self.keys >> _SHIFT] = True

    def _plain_enough(self, flat: np.ndarray) -> np.ndarray:
        """Windows with at least two words that are no placeholders; the others are hashed as they are."""
        n = len(flat) - WINDOW + 1
        plain = self.kind[flat] == 0
        return np.array([plain[k : k + WINDOW].sum() >= 2 for k in range(n)], bool) if n > 0 else np.zeros(0, bool)

    # ---- documents

    def ids_of(self, text: str) -> np.ndarray:
        found = words(text)
        ids = np.fromiter(map(self.lookup.__getitem__, found), np.int64, len(found))
        if self.compounds and (ids >= len(self.kind)).any():
            ids = np.array([s for i in ids.tolist() for s in (self.compounds.get(i) or (i,))], np.int64)
        return ids

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, int, int, int]]:
        """``(text number, item_id, kind, n_words, n_replaced, n_slots)``."""
        if not len(self.keys):
            return
        parts = [self.ids_of(t) if t else _NONE for t in texts]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        drop = self.words_are_single[flat] if len(flat) else np.zeros(0, bool)
        for a, b in self.pairs:
            at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b) & (doc[:-1] == doc[1:])) if len(flat) else []
            if len(at):
                drop[at] = drop[at + 1] = True
        flat, doc = flat[~drop], doc[~drop]
        if len(flat) < WINDOW:
            return
        windows = []
        whole = doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]
        template, raw = _hashes(self.template[flat]), _hashes(self.raw[flat])
        for h, other in ((template, whole), (raw, whole & (raw != template))):  # a window without placeholders is looked up once
            some = np.flatnonzero(other & self.present[h >> _SHIFT])
            windows.append((some, np.searchsorted(self.keys, h[some], "left"), np.searchsorted(self.keys, h[some], "right")))
        some, low, high = (np.concatenate([w[i] for w in windows]) for i in range(3))
        order = np.argsort(some, kind="stable")
        some, low, n = some[order], low[order], (high - low)[order]
        some, low, n = some[n > 0], low[n > 0], n[n > 0]
        full = self._unfolded(some, n, doc)
        if n[full].sum() > _MOST_HITS and len(texts) > 1:
            half = len(texts) // 2
            yield from self.search(texts[:half])
            yield from ((number + half, *row) for number, *row in self.search(texts[half:]))
            return
        at, entry = self._hits(some, low, n, full, doc)
        if len(at) < self.least:
            return
        item, place = self.of_item[entry], self.at[entry]
        group, shift = doc[at] * np.int64(len(self.items)) + item, at - place
        order = np.lexsort((at, shift, group))
        at, group, shift, place = at[order], group[order], shift[order], place[order]
        more = self.least - 1
        near = np.flatnonzero((group[more:] == group[: len(group) - more]) & (shift[more:] - shift[: len(shift) - more] <= 6))
        if not len(near):
            return
        marked = np.zeros(len(at), bool)
        for k in range(self.least):
            marked[near + k] = True
        at, group, place = at[marked], group[marked], place[marked]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(starts, np.append(starts[1:], len(group))):
            number, which = divmod(int(group[a]), len(self.items))
            first = int(bounds[number])
            row = self._compare(which, flat[first : bounds[number + 1]], [(int(p), int(q) - first) for p, q in zip(place[a:b], at[a:b])])
            if row:
                yield (number, self.items[which][0], *row)

    def _unfolded(self, some: np.ndarray, n: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Windows that lead to all their items: rare ones, and frequent ones where enough of them for a leak are close together."""
        full = n <= FREQUENT
        often = np.flatnonzero(~full)
        if len(often):
            place, of = some[often], doc[some[often]]
            more = self.least - 1
            near = np.flatnonzero((of[more:] == of[: len(of) - more]) & (place[more:] - place[: len(place) - more] < _SPAN))
            for k in range(self.least):
                full[often[near + k]] = True
        return full

    def _hits(self, some: np.ndarray, low: np.ndarray, n: np.ndarray, full: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in the texts, entry of the index)`` of all hits that can matter."""

        def every(some, low, n):
            return np.repeat(some, n), (np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype(np.int64)

        at, entry = every(some[full], low[full], n[full])
        if full.all():
            return at, entry
        items = np.int64(max(1, len(self.items)))
        named = np.unique(doc[at] * items + self.of_item[entry])  # items that a document's other windows name
        of, item = named // items, named % items
        where, key = some[~full], self.rank[low[~full]]
        first, last = np.searchsorted(of, doc[where], "left"), np.searchsorted(of, doc[where], "right")
        which, pick = every(np.arange(len(where)), first, last - first)
        wanted = key[which] * items + item[pick]
        a, b = np.searchsorted(self.entry_of, wanted, "left"), np.searchsorted(self.entry_of, wanted, "right")
        more_at, more_entry = every(where[which], a, b - a)
        return np.concatenate([at, more_at]), np.concatenate([entry, more_entry])

    def _compare(self, which: int, text: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[str, int, int, int] | None:
        _, parents, start, places = self.items[which]
        seeds = sorted({(start[p + k], q + k) for p, q in seeds for k in range(WINDOW) if p + k in start})
        best = _longest(parents, text.tolist(), seeds, places)
        if best and best[0] >= self.min_words:
            return "leaked", best[0], best[1], 0
        kinds = np.where(self.kind > 0, -self.kind, np.arange(len(self.kind)))
        path = _longest([tuple(int(kinds[s]) for s in p) for p in parents], kinds[text].tolist(), seeds, places)
        if path and path[0] >= self.min_words:
            filled: dict[int, int] = {}
            for j, q in path[2]:
                for k, s in enumerate(parents[j]):
                    if self.kind[s] in (_NUMBER, _NAME) and filled.setdefault(s, int(text[q + k])) != int(text[q + k]) and OOV not in (filled[s], text[q + k]):
                        return None  # one slot filled in two ways
            if filled and len(path[2]) - len(filled) >= self.min_words // 2:
                return "reparameterised", path[0], path[1], len(filled)
        return None


def _longest(parents: list[tuple[int, ...]], text: list[int], seeds: list[tuple[int, int]], places: list[int]):
    """Longest run of consecutive item words with at most one replaced in any ten, ends not replaced.

    ``(words, replaced, [(word, place)])``; ``places`` numbers the words among all of the
    item, its fillers included, which are optional and count. A replaced word stands for one to three
    words of the text, so that the following words must go on.
    """
    best, seen = None, set()
    m, n = len(parents), len(text)
    for j0, q0 in seeds:
        if (j0, q0) in seen or tuple(text[q0 : q0 + len(parents[j0])]) != parents[j0]:
            continue
        path = [(j0, q0, True)]
        j, q = j0 + 1, q0 + len(parents[j0])
        while j < m:
            size = len(parents[j])
            if tuple(text[q : q + size]) == parents[j]:
                path.append((j, q, True))
            elif j + 1 < m:
                size = next((k for k in dict.fromkeys((size, 1, 2, 3)) if q + k < n and tuple(text[q + k : q + k + len(parents[j + 1])]) == parents[j + 1]), 0)
                if not size:
                    break
                path.append((j, q, False))
            else:
                break
            j, q = j + 1, q + size
        j, q, left = j0 - 1, q0, []
        while j >= 0:
            size = len(parents[j])
            if q >= size and tuple(text[q - size : q]) == parents[j]:
                left.append((j, q - size, True))
            elif j > 0:
                before = parents[j - 1]
                size = next((k for k in dict.fromkeys((size, 1, 2, 3)) if q - k - len(before) >= 0 and tuple(text[q - k - len(before) : q - k]) == before), 0)
                if not size:
                    break
                left.append((j, q - size, False))
            else:
                break
            j, q = j - 1, q - size
        path = left[::-1] + path
        seen.update((j, q) for j, q, same in path if same)
        low, last = 0, None
        for k, (j, _, same) in enumerate(path):
            if not same:
                if last is not None and places[j] - places[path[last][0]] < 10:
                    low = last + 1
                last = k
                continue
            length = places[j] - places[path[low][0]] + 1
            if best is None or length > best[0]:
                run = path[low : k + 1]
                best = (length, sum(not s for _, _, s in run), [(j, q) for j, q, s in run if s])
    return best


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = 15, block_chars: int = 32_000_000,
) -> DataFrame:
    """``doc_id, item_id, kind, n_words, n_replaced, n_slots``: pairs of a document and an item it contains, each once.

    ``kind`` is ``leaked`` or ``reparameterised``; ``n_words`` the longest run found.
    Items under ``min_words`` words and null or blank texts are in no pair. Rows with the
    same doc_id are searched each, the pair is returned once with its longest run (leaked
    before reparameterised). Ids are BIGINT; rows with a null id are left out. Other
    columns aren't carried.

    Whole texts are searched; every document crosses to Python once per block of at most
    ``block_chars`` characters of items (one block for any usual test set). The index of
    a block is what is broadcast, so its size is bounded whatever the corpus.
    """
    spark = docs.sparkSession
    listed = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).distinct()
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    narrow = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else listed
        index = spark.sparkContext.broadcast(ItemIndex([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], min_words))
        found = narrow.mapInArrow(_searcher(index), SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct((F.col("kind") == "leaked").alias("is_leak"), "n_words", -F.col("n_replaced"), "n_slots")).alias("b")
    one = out.groupBy("doc_id", "item_id").agg(best)
    return one.select("doc_id", "item_id", F.when(F.col("b.is_leak"), "leaked").otherwise("reparameterised").alias("kind"), F.col("b.n_words").alias("n_words"), (-F.col("b.col3")).alias("n_replaced"), F.col("b.n_slots").alias("n_slots"))


def _searcher(index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, start, size = [], 0, 0
            for i in range(len(ids)):  # about 4 million characters at a time
                size += len(texts[i].as_py() or "")
                if size > 4_000_000 or i + 1 == len(ids):
                    part = texts.slice(start, i + 1 - start).to_pylist()
                    rows += [(ids[start + n], *row) for n, *row in index.value.search(part)]
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return search


def leaks_by_item(leaks: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Per item: in how many documents it leaked or appears re-parameterised (0 included)."""
    counts = leaks.groupBy("item_id").agg(F.sum((F.col("kind") == "leaked").cast("bigint")).alias("n_leaked"), F.sum((F.col("kind") == "reparameterised").cast("bigint")).alias("n_reparameterised"), F.max("n_words").alias("longest_run"))
    return items.select(F.col(item_id).cast("bigint").alias("item_id")).distinct().join(counts, "item_id", "left").na.fill(0, ["n_leaked", "n_reparameterised", "longest_run"])
