"""Most similar vectors for every vector: balanced posting lists.

Centroids are fitted on a bounded sample and balanced by splitting large cells. The cells
near a vector are found by a matrix product with all centroids or, on request, over a
graph of the centroids that is entered through pivots. A vector goes
to its nearest list and, being a boundary vector, also to every list whose centroid is
nearly as near (distance-ratio pruning), so that two similar vectors share a list. Each
list is compared within itself, the results are merged per vector.

A list over its bound is balanced once more where it is compared: centroids are fitted to
its own members and the same placing and comparing goes on inside, so that a dense region
costs no more than any other.

Equal vectors under several ids are one entry: their class is compared once and its
members are put back at the end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.session import cut_lineage

_SCALE = float((1 << 23) - 1)
CODED = "id string, code binary"
_CODED = pa.schema([("id", pa.string()), ("code", pa.binary())])
_HASHED = pa.schema([("id", pa.string()), ("_h", pa.binary()), ("code", pa.binary())])
_PLACED = pa.schema([("list", pa.int32()), ("part", pa.int32()), ("id", pa.string()), ("code", pa.binary())])
PLACED = "list int, part int, id string, code binary"
_NEAR = pa.schema([("id", pa.string()), ("others", pa.list_(pa.string())), ("similarities", pa.list_(pa.float64()))])
_CLASSES = "array<struct<_h: binary, entry: string>>"
NEAR = "id string, others array<string>, similarities array<double>"  # two arrays are smaller in a shuffle than one of pairs
PAIRS = "id string, other string, similarity double"
_PAIRS = pa.schema([("id", pa.string()), ("other", pa.string()), ("similarity", pa.float64())])


# ---------------------------------------------------------------- codes: 24 bits a value


def encode(unit: np.ndarray) -> list[bytes]:
    """Unit vectors as 24-bit fixed point; the error of a cosine is about 1e-8."""
    whole = np.rint(unit * _SCALE).astype(np.int32)
    high, low = (whole >> 8).astype("<i2"), (whole & 255).astype(np.uint8)
    return [h.tobytes() + b.tobytes() for h, b in zip(high, low)]


def decode(codes: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), 3 * dim)
    high = np.ascontiguousarray(raw[:, : 2 * dim]).view("<i2").astype(np.float32)
    return (high * 256 + raw[:, 2 * dim :].astype(np.float32)) * np.float32(1 / _SCALE)


def _unit_codes(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, list[bytes]]:
    """Places of the usable vectors in a batch of ``id, embedding`` and their codes."""
    flat = batch.column(1).flatten()
    if not len(flat):
        return np.zeros(0, np.int64), []
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
    norm = np.sqrt((x * x).sum(1))
    keep = np.flatnonzero(np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm))
    return keep, encode(x[keep] / norm[keep, None])


def _rows(vectors: DataFrame, dim: int, vector_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vector_id).cast("string").alias("id"), F.col(embedding).cast("array<float>").alias("embedding"))
    return rows.filter(F.col("id").isNotNull() & (F.size("embedding") == dim))


def usable(vectors: DataFrame, dim: int, vector_id: str = "id", embedding: str = "embedding") -> DataFrame:
    """``id, code``: unit vectors of the rows that take part.

    Embeddings that are null, not ``dim`` long, all zero or hold a null, NaN or infinity
    are left out, as are rows with a null id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, codes = _unit_codes(batch, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(codes, pa.binary())], schema=_CODED)

    return _rows(vectors, dim, vector_id, embedding).mapInArrow(run, CODED)


def _hash(code: bytes) -> bytes:
    return hashlib.blake2b(code, digest_size=16).digest()


def hashed(vectors: DataFrame, dim: int, share: float, vector_id: str = "id", embedding: str = "embedding") -> DataFrame:
    """``id, _h, code``: usable rows with the hash of their unit vector; the vector itself only for about ``share`` of the hashes.

    Copies within a batch leave it once.
    """
    below = min(int(share * (1 << 32)), 1 << 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, codes = _unit_codes(batch, dim)
            seen: dict[tuple[str, bytes], bytes] = {}
            for name, code in zip(batch.column(0).take(pa.array(keep)).to_pylist(), codes):
                seen.setdefault((name, _hash(code)), code)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in seen], pa.string()), pa.array([h for _, h in seen], pa.binary()), pa.array([c if int.from_bytes(h[:4], "little") < below else None for (_, h), c in seen.items()], pa.binary())],
                schema=_HASHED,
            )

    return _rows(vectors, dim, vector_id, embedding).mapInArrow(run, "id string, _h binary, code binary")


# ---------------------------------------------------------------- centroids and their graph


class Centroids:
    """Balanced centroids, searched by a matrix product or from pivots by a beam over their neighbour graph."""

    def __init__(self, points: np.ndarray, seed: int = 5, degree: int = 16):
        self.points = points.astype(np.float32)
        n = len(points)
        rng = np.random.default_rng(seed)
        self.pivots = np.sort(rng.choice(n, min(n, max(1, int(2 * np.sqrt(n)))), replace=False))
        self.degree = min(degree, max(1, n - 1))
        self.graph: np.ndarray | None = None  # built when first used

    def _neighbours(self) -> np.ndarray:
        out = np.empty((len(self.points), self.degree), np.int64)
        for a in range(0, len(self.points), 512):
            s = self.points[a : a + 512] @ self.points.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
            out[a : a + 512] = np.argpartition(-s, self.degree - 1, axis=1)[:, : self.degree]
        return out

    def search(self, x: np.ndarray, most: int, graph: bool = False, beam: int = 12, hops: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest centroids of each row, best first, and their similarities.

        By default by one matrix product with all centroids; by the graph on request
        (which misses some, see the README).
        """
        ids, sims = [], []
        for a in range(0, len(x), 1024):
            i, s = self._search(x[a : a + 1024], most, max(beam, most), hops) if graph else self._product(x[a : a + 1024], most)
            ids.append(i)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def _product(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.points.T
        k = min(most, s.shape[1])
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)

    def _search(self, x: np.ndarray, most: int, beam: int, hops: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.points)
        if beam * 4 >= n:  # the beam would see nearly all of them
            return self._product(x, most)
        if self.graph is None:
            self.graph = self._neighbours()
        entry = x @ self.points[self.pivots].T
        k = min(beam, len(self.pivots))
        at = np.argpartition(-entry, k - 1, axis=1)[:, :k]
        found, sim = self.pivots[at], np.take_along_axis(entry, at, 1)
        seen = np.zeros((len(x), n), bool)
        np.put_along_axis(seen, found, True, 1)
        fresh = found
        rows = np.arange(len(x))[:, None]
        for _ in range(hops):
            around = self.graph[fresh].reshape(len(x), -1)
            around.sort(1)
            new = ~seen[rows, around]
            new[:, 1:] &= around[:, 1:] != around[:, :-1]
            r, c = np.nonzero(new)
            if not len(r):
                break
            which = around[r, c]
            seen[r, which] = True
            values = np.einsum("ij,ij->i", x[r], self.points[which])
            width = np.bincount(r, minlength=len(x)).max()
            slot = np.arange(len(r)) - np.repeat(np.searchsorted(r, np.arange(len(x))), np.bincount(r, minlength=len(x)))
            ids2, sim2 = np.zeros((len(x), width), np.int64), np.full((len(x), width), -9, np.float32)
            ids2[r, slot], sim2[r, slot] = which, values
            ids, sims = np.concatenate([found, ids2], 1), np.concatenate([sim, sim2], 1)
            is_new = np.concatenate([np.zeros(found.shape, bool), sim2 > -9], 1)
            k = min(beam, ids.shape[1])
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            found, sim, came = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), np.take_along_axis(is_new, top, 1)
            if not came.any():
                break
            # only what is new in the beam is expanded; others repeat a seen entry, which costs nothing
            fresh = np.where(came, found, found[:, :1])[:, : max(4, beam // 2)]
        order = np.argsort(-sim, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(found, order, 1), np.take_along_axis(sim, order, 1)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 2, seed: int = 5) -> Centroids:
    """Spherical k-means on a sample; cells over twice the mean are split, empty ones moved there."""
    rng = np.random.default_rng(seed)
    n = len(sample)
    lists = max(1, min(lists, n))
    points = sample[np.sort(rng.choice(n, lists, replace=False))].copy()
    for step in range(rounds):
        of = np.concatenate([(sample[a : a + 2048] @ points.T).argmax(1) for a in range(0, n, 2048)])
        count = np.bincount(of, minlength=lists)
        total = np.zeros_like(points)
        np.add.at(total, of, sample)
        norm = np.sqrt((total * total).sum(1))
        good = (count > 0) & (norm > 1e-9)
        points[good] = total[good] / norm[good, None]
        if step + 1 < rounds:
            free = np.flatnonzero(count <= 1)
            large = np.flatnonzero(count > 2 * n / lists)
            for k, cell in zip(free, np.repeat(large, 2)):
                points[k] = sample[rng.choice(np.flatnonzero(of == cell))]
    return Centroids(points, seed)


# ---------------------------------------------------------------- placing and comparing


def near_lists(ids: np.ndarray, sims: np.ndarray, ratio: float) -> np.ndarray:
    """Distance-ratio pruning: lists whose centroid is at most ``ratio`` times as far as the nearest."""
    distance = np.sqrt(np.maximum(2 - 2 * sims, 0))
    return distance <= ratio * distance[:, :1] + 1e-6


def place(vectors: DataFrame, centroids, parts, members: DataFrame | None, dim: int, most: int, ratio: float, graph: bool, vector_id: str, embedding: str) -> DataFrame:
    """``list, part, id, code`` with a row for each list of a vector, from one scan.

    ``members`` has ``id`` and ``classes`` (hash and entry) of the ids in classes with
    copies; such a class is placed once a task, under its entry's id. ``parts`` says into
    how many parts a list is divided: a vector then meets its own part and each other one.
    """
    rows = _rows(vectors, dim, vector_id, embedding)
    rows = rows.withColumn("classes", F.lit(None).cast(_CLASSES)) if members is None else rows.join(members, "id", "left").select("id", "embedding", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, divided = centroids.value, parts.value
        done: set[bytes] = set()  # classes with copies that this task has placed
        for batch in batches:
            keep, codes = _unit_codes(batch, dim)
            names, classes = (batch.column(i).take(pa.array(keep)).to_pylist() for i in (0, 2))
            use = []
            for i, known in enumerate(classes):
                entry = next((c for c in known or () if bytes(c["_h"]) == _hash(codes[i])), None)
                if entry is not None:
                    if entry["_h"] in done:
                        continue
                    done.add(entry["_h"])
                    names[i] = entry["entry"]
                use.append(i)
            if not use:
                continue
            codes, names = [codes[i] for i in use], [names[i] for i in use]
            found, sims = index.search(decode(codes, dim), most, graph)
            row, at = np.nonzero(near_lists(found, sims, ratio))
            lists = found[row, at]
            n = divided[lists]
            own = np.array([zlib.crc32(c) for c in codes], np.int64)[row] % n
            again = np.repeat(np.arange(len(row)), n)  # once for each part it meets
            other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            part = np.minimum(own[again], other) * n[again] + np.maximum(own[again], other)
            take = pa.array(row[again])
            yield pa.RecordBatch.from_arrays([pa.array(lists[again].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(names, pa.string()).take(take), pa.array(codes, pa.binary()).take(take)], schema=_PLACED)

    return rows.mapInArrow(run, PLACED)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, least: float, most_rows: int, ratio: float, copies: int, depth: int = 0) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, other row, similarity)`` of the ``k`` most similar rows within a list; ids are in order.

    Over ``most_rows`` the list is placed into lists of its own (see the module's text).
    """
    n = len(ids)
    if n > most_rows and depth < 4:
        index = fit_centroids(x[np.linspace(0, n - 1, min(n, 20_000)).astype(np.int64)], max(2, 2 * n // most_rows), seed=11 + depth)
        if (index.points.max(0) - index.points.min(0)).max() > 1e-6:
            found, sims = index.search(x, copies)
            row, at = np.nonzero(near_lists(found, sims, ratio))
            lists = found[row, at]
            order = np.lexsort((row, lists))
            row, lists = row[order], lists[order]
            out = []
            for a, b in zip(np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])), [*np.flatnonzero(lists[1:] != lists[:-1]) + 1, len(lists)]):
                mine = row[a:b]
                if len(mine) < n:  # else the vectors can't be told apart, and are compared in blocks
                    out += [(mine[r], mine[c], s) for r, c, s in _nearest(ids[mine], x[mine], k, least, most_rows, ratio, copies, depth + 1)]
                else:
                    return _blocks(ids, x, k, least)
            return out
    return _blocks(ids, x, k, least)


def _blocks(ids: np.ndarray, x: np.ndarray, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same by comparing all rows, in blocks of bounded size on both sides."""
    n, top = len(ids), min(k, len(ids))
    out, base = [], np.int64(n + 1)
    for a in range(0, n, 1024):
        rows = len(x[a : a + 1024])
        best = np.full((rows, top), -(1 << 62), np.int64)
        where = np.zeros((rows, top), np.int64)
        for b in range(0, n, 8192):
            s = (x[a : a + rows] @ x[b : b + 8192].T).astype(np.float64)
            own = np.arange(max(a, b), min(a + rows, b + s.shape[1]))
            s[own - a, own - b] = -9
            s[s < least - 1e-6] = -9
            key = np.rint(s * 1e6).astype(np.int64) * base + np.arange(n - b, n - b - s.shape[1], -1)  # equal to six decimals: smaller id first
            m = min(top, s.shape[1])
            at = np.argpartition(-key, m - 1, axis=1)[:, :m]
            best, where = np.concatenate([best, np.take_along_axis(key, at, 1)], 1), np.concatenate([where, at + b], 1)
            keep = np.argpartition(-best, top - 1, axis=1)[:, :top]
            best, where = np.take_along_axis(best, keep, 1), np.take_along_axis(where, keep, 1)
        r, c = np.nonzero(best > -8 * 1_000_000 * base)
        if len(r):
            other = where[r, c]
            out.append((a + r, other, np.einsum("ij,ij->i", x[a + r].astype(np.float64), x[other].astype(np.float64))))
    return out


def compare_list(table: pa.Table, dim: int, k: int, least: float, most_rows: int = 8_000, ratio: float = 1.3, copies: int = 3) -> pa.Table:
    """``id, others, similarities``: the ``k`` most similar entries of every entry within a list, each id once."""
    rows = sorted(set(zip(table.column("id").to_pylist(), table.column("code").to_pylist())))
    ids, x = np.array([r[0] for r in rows], object), decode([r[1] for r in rows], dim)
    found = _nearest(ids, x, k, least, most_rows, ratio, copies)
    if not found:
        return _NEAR.empty_table()
    row, other, s = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((other, -np.round(s, 6), row))
    row, other, s = row[order], other[order], s[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])])  # the same pair from several inner lists
    row, other, s = row[fresh], other[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    row, other, s = row[place < k], other[place < k], s[place < k]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = pa.array(np.append(starts, len(row)).astype(np.int32))
    return pa.table([pa.array(ids[row[starts]], pa.string()), pa.ListArray.from_arrays(ends, pa.array(ids[other], pa.string())), pa.ListArray.from_arrays(ends, pa.array(s))], schema=_NEAR)


class _Classes:
    """Classes of equal vectors among the usable rows.

    ``members``: ``id, entry, _h, several`` of the rows of classes with copies; an entry is
    the smallest id of its class. ``first``: ``entry, id``, the first ids of the classes
    with several. And how many entries, members and members of classes with several ids
    there are.

    Only ids and hashes are shuffled, combined before; a class with a third of all rows is
    gathered in salted parts, and its members are ranked with a limit.
    """

    def __init__(self, narrow: DataFrame, keep: int):
        salt = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")
        one = narrow.groupBy("_h", "id").agg(F.count("*").alias("n"))
        salted = one.groupBy("_h", salt.alias("_s")).agg(F.min("id").alias("entry"), F.count("*").alias("ids"), F.sum("n").alias("n"))
        classes = salted.groupBy("_h").agg(F.min("entry").alias("entry"), F.sum("ids").alias("ids"), F.sum("n").alias("n"))
        classes = cut_lineage(classes.select("_h", "entry", "ids", (F.col("ids") > 1).alias("several"), (F.col("n") > 1).alias("copied")))
        total = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("ids"))), F.lit(0))
        counts = classes.agg(F.count("*").alias("n"), total("copied").alias("members"), total("several").alias("several")).first()
        self.n, self.n_members, self.n_several = counts["n"], counts["members"], counts["several"]
        wide = classes.filter("copied").select("_h", "entry", "several", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s"))
        members = narrow.select("id", "_h").withColumn("_s", salt).join(wide, ["_h", "_s"]).select("id", "entry", "_h", "several").distinct()
        self.members = cut_lineage(members) if self.n_members else None
        if self.n_several:
            rank = F.row_number().over(Window.partitionBy("entry").orderBy("id"))
            self.first = self.members.filter("several").withColumn("_r", rank).filter(F.col("_r") <= keep).select("entry", "id")


def most_similar(
    vectors: DataFrame, k: int = 5, dim: int = 128, min_similarity: float = -1.0, list_size: int = 200, most: int = 3, ratio: float = 1.3,
    max_sample: int = 40_000, max_lists: int = 16_384, graph: bool = False, vector_id: str = "id", embedding: str = "embedding", max_part: int = 200_000, max_broadcast: int = 200_000,
) -> DataFrame:
    """``id, other, similarity``: for every usable vector the ``k`` most similar other ids.

    Cosine similarity, equal to six decimals: smaller id first; only pairs of at least
    ``min_similarity``. Rows alike are copies and count once; equal vectors under other
    ids are neighbours with similarity 1. Unusable embeddings (see ``usable``) take no
    part. Other columns aren't carried.

    Centroids are fitted on about ``max_sample`` vectors, or six a list if that is more
    (chosen by a hash of the vector), one for about ``list_size`` vectors; every vector is
    indexed. A vector is put into at most ``most`` lists. A list of over 10 x
    ``list_size`` vectors is balanced again where it is compared; one that the sample
    shows to have over ``max_part``, too many for a task, is divided into parts, and every
    two parts are compared. Pairs that share no list are missed: recall against brute
    force is in the README, about 1 for pairs of 0.9 and more. ``graph`` searches the
    centroids over their graph. Broadcast are the centroids and, up to ``max_broadcast``
    rows, the members of classes with copies; beyond that they are joined by a shuffle.

    The vectors are scanned twice: once for their hashes (only ids, hashes and the sample
    leave that scan), once to be placed.
    """
    spark = vectors.sparkSession
    rows = vectors.count()  # of the files' own counts
    sample = max(max_sample, 6 * min(max_lists, rows // list_size))
    narrow = cut_lineage(hashed(vectors, dim, min(1.0, sample / max(1, rows)), vector_id, embedding))
    classes = _Classes(narrow.select("id", "_h"), k + 1)
    if not classes.n:
        return spark.createDataFrame([], PAIRS)
    index, parts = _index(spark, narrow, classes.n, dim, list_size, max_lists, most, ratio, max_part)
    by_id = None
    if classes.n_members:
        by_id = classes.members.groupBy("id").agg(F.collect_list(F.struct("_h", "entry")).alias("classes"))
        by_id = F.broadcast(by_id) if classes.n_members <= max_broadcast else by_id
    placed = place(vectors, index, parts, by_id, dim, most, ratio, graph, vector_id, embedding)
    # as many tasks as keep what each reads at about 8 MB, whatever the session's number of shuffle partitions
    tasks = int(most * classes.n * (3 * dim + 64) >> 23)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if tasks > least:
        placed = placed.repartition(tasks, "list", "part")
    found = placed.groupBy("list", "part").applyInArrow(lambda table: compare_list(table, dim, k + 1, min_similarity, 10 * list_size, ratio, most), NEAR)
    # without a threshold every vector has its neighbours to merge; above one few have
    return _expand(found, classes, k, min_similarity, max_broadcast, tasks if tasks > least and min_similarity <= -1 else 0)


def _index(spark, narrow: DataFrame, n: int, dim: int, list_size: int, max_lists: int, most: int, ratio: float, max_part: int):
    """Centroids from the sampled vectors, each once, and into how many parts each list is divided."""
    codes = narrow.filter(F.col("code").isNotNull()).select("code").distinct().collect()
    sample = decode(sorted(bytes(r.code) for r in codes), dim)
    share = spark.sparkContext.broadcast
    if not len(sample):  # few usable vectors among many rows, none of them in the sample by its hash
        return share(Centroids(np.full((1, dim), dim**-0.5))), share(np.array([max(1, -(-n // max_part))]))
    index = fit_centroids(sample, min(max_lists, max(1, n // list_size)))
    found, sims = index.search(sample, most)
    row, at = np.nonzero(near_lists(found, sims, ratio))
    size = np.bincount(found[row, at], minlength=len(index.points)) * (n / len(sample))
    return share(index), share(np.maximum(1, np.ceil(size / max_part)).astype(np.int64))


def _best(near, k: int):
    """The ``k`` best of an array of neighbours, each once; equal to six decimals: smaller id first."""
    keyed = F.array_sort(F.array_distinct(F.transform(near, lambda x: F.struct((-F.round(x["similarity"], 6)).alias("s"), x["other"].alias("other"), x["similarity"].alias("similarity")))))
    # the same pair may come from several lists, with the same rounded similarity
    return F.slice(F.filter(keyed, lambda x, i: (i == 0) | (F.get(keyed, i - 1)["other"] != x["other"])), 1, k)


def _expand(found: DataFrame, classes: _Classes, k: int, least: float, max_broadcast: int, tasks: int) -> DataFrame:
    """Neighbours over all lists of an entry; entries become ids.

    A neighbour stands for the first ids of its class, and all members of a class share
    its list. Everything after the one shuffle by entry stays in its stage, as long as the
    classes with several ids are few; many are joined by a shuffle in salted parts.
    """
    final = lambda df: df.select("id", F.explode(F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)).alias("n")).select("id", F.col("n.other").alias("other"), F.col("n.similarity").alias("similarity")).filter(F.col("similarity") >= least)
    pairs = F.arrays_zip(F.flatten(F.collect_list("others")).alias("other"), F.flatten(F.collect_list("similarities")).alias("similarity"))
    by_id = lambda df: (df.repartition(tasks, "id") if tasks else df).groupBy("id").agg(pairs.alias("near"))
    if not classes.n_several:
        return final(by_id(found).select("id", _best("near", k + 1).alias("near")))
    few = classes.n_several <= max_broadcast
    own = classes.first.select(F.col("entry").alias("id")).distinct().select("id", F.array("id").alias("others"), F.array(F.lit(1.0)).alias("similarities"))
    lists = by_id(found.unionByName(own)).select("id", F.explode(_best("near", k + 2)).alias("n"))
    names = classes.first.groupBy(F.col("entry").alias("other")).agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    named = lists.select("id", F.col("n.other").alias("other"), F.col("n.similarity").alias("similarity")).join(F.broadcast(names) if few else names, "other", "left")
    named = named.select("id", F.explode(F.coalesce("_ids", F.array("other"))).alias("other"), "similarity")
    lists = named.groupBy("id").agg(F.collect_list(F.struct("other", "similarity")).alias("near")).select("id", _best("near", k + 1).alias("near"))
    members = classes.members.filter("several").select(F.col("id").alias("_id"), "entry")
    if few:
        shared = lists.join(F.broadcast(members), F.col("id") == F.col("entry"), "left")
        return final(shared.select(F.coalesce("_id", "id").alias("id"), "near"))
    lists = cut_lineage(lists)
    entries = classes.first.select(F.col("entry").alias("id")).distinct()
    salted = lists.join(entries, "id", "left_semi").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    members = members.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(16)).cast("int"))
    many = members.join(salted.withColumnRenamed("id", "entry"), ["entry", "_s"]).select(F.col("_id").alias("id"), "near")
    return final(lists.join(entries, "id", "left_anti").unionByName(many))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``id_a, id_b, similarity``: each pair once, the smaller string first."""
    pair = neighbours.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "similarity")
    return pair.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


class _Best:
    """The ``k`` best rows of every query so far, each id once; equal to six decimals: smaller id first."""

    def __init__(self, names: np.ndarray, points: np.ndarray, k: int):
        self.names, self.points, self.k = names, points, k
        self.rows: list[dict[str, float]] = [{} for _ in names]
        self.worst = np.full(len(names), -2.0)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        ids, first = np.unique(ids, return_index=True)
        x = x[first]
        for a in range(0, len(self.points), 2048):
            for b in range(0, len(ids), 4096):
                self._block(a, ids[b : b + 4096], x[b : b + 4096])

    def _block(self, a: int, ids: np.ndarray, x: np.ndarray) -> None:
        s = self.points[a : a + 2048] @ x.T
        least = self.worst[a : a + 2048] - 2e-6
        new = np.flatnonzero(least < -1.5)
        if len(new) and len(ids) > self.k + 1:  # a query without rows yet: only its best ones
            least[new] = np.partition(s[new], -(self.k + 1), axis=1)[:, -(self.k + 1)] - 2e-6
        r, c = np.nonzero(s >= least[:, None])
        if not len(r):
            return
        exact = np.einsum("ij,ij->i", self.points[a + r].astype(np.float64), x[c].astype(np.float64))
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        for i, j in zip(starts, np.append(starts[1:], len(r))):
            self._merge(a + int(r[i]), ids[c[i:j]], exact[i:j])

    def _merge(self, query: int, ids: np.ndarray, sims: np.ndarray) -> None:
        if len(ids) > 4 * self.k:  # ids are in order, so a stable sort keeps ties right
            keep = np.argsort(-np.round(sims, 6), kind="stable")[: self.k + 1]
            ids, sims = ids[keep], sims[keep]
        row = self.rows[query]
        row.update((i, float(v)) for i, v in zip(ids, sims) if i != self.names[query])
        if len(row) > self.k:
            best = sorted(row.items(), key=lambda x: (-round(x[1], 6), x[0]))[: self.k]
            self.rows[query] = dict(best)
        if len(self.rows[query]) == self.k:
            self.worst[query] = min(self.rows[query].values())


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, dim: int = 128, block: int = 20_000, vector_id: str = "id", embedding: str = "embedding") -> DataFrame:
    """``id, other, similarity``: exactly the ``k`` most similar other ids for a stated set of queries, against all rows.

    Rows are never moved: the queries go to the tasks in blocks of at most ``block``,
    each task keeps its own best rows of each query, and only those are shuffled. Copies
    and unusable embeddings as in ``most_similar``.
    """
    spark = vectors.sparkSession
    coded = usable(vectors, dim, vector_id, embedding)
    asked = usable(queries, dim, vector_id, embedding).distinct()
    blocks = max(1, -(-asked.count() // block))
    out = spark.createDataFrame([], PAIRS)
    for number in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).orderBy("id").collect()
        if part:
            sent = spark.sparkContext.broadcast((np.array([r.id for r in part], object), decode([bytes(r.code) for r in part], dim)))
            out = out.unionByName(coded.mapInArrow(_searcher(sent, dim, k), PAIRS))
    by = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 6)), "other")
    one = out.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return one.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def _searcher(sent, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*sent.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(np.array(batch.column("id").to_pylist(), object), decode(batch.column("code").to_pylist(), dim))
        rows = [(name, other, s) for name, row in zip(best.names, best.rows) for other, s in row.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PAIRS)], schema=_PAIRS)

    return run


def exact_most_similar(rows: pd.DataFrame, k: int, dim: int = 128) -> dict[str, list[tuple[str, float]]]:
    """Brute force on one machine, for tests and for measuring recall."""
    kept = {}
    for name, e in zip(rows["id"], rows["embedding"]):
        if name is None or e is None or len(e) != dim:
            continue
        v = np.asarray(e, np.float64)
        if np.isfinite(v).all() and (v != 0).any():
            kept[name] = v / np.sqrt(v @ v)
    ids = np.array(sorted(kept), object)
    if not len(ids):
        return {}
    x = np.stack([kept[i] for i in ids])
    out = {}
    for a in range(0, len(ids), 512):
        s = np.round(x[a : a + 512] @ x.T, 6)
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
        top = np.lexsort((np.broadcast_to(np.arange(len(ids)), s.shape), -s), axis=1)[:, :k]
        for r, row in enumerate(top):
            out[ids[a + r]] = [(ids[j], float(s[r, j])) for j in row if s[r, j] > -9]
    return out
