import random

import numpy as np
import pytest

from kinolake.operators.greedy import chain, enter, greedy_bins, summarise, walk


def plain(sizes, limit):
    out, fill, bins = [], 0, 0
    for v in sizes:
        if bins and fill + v <= limit:
            fill += v
        else:
            fill, bins = v, bins + 1
        out.append(bins - 1)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_blocks_compose_to_the_sequential_rule(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 5, 20, 100])
    sizes = [rng.choice([0, 0, rng.randint(0, limit), rng.randint(0, limit * 2)]) for _ in range(rng.randint(0, 120))]
    want, got, fill, bins = plain(sizes, limit), [], 0, 0
    block = rng.choice([1, 2, 7, 50])
    for a in range(0, len(sizes), block):
        part = np.array(sizes[a : a + block], np.int64)
        got += walk(part, limit, fill, bins).tolist()
        before, ends, counts = summarise(part, limit)
        at = 0 if bins == 0 else int(np.searchsorted(before, limit - fill, side="right"))
        if at < len(before):
            fill, bins = int(ends[at]), bins + int(counts[at])
        else:
            fill += int(ends[-1])
    assert got == want


@pytest.mark.parametrize("seed", range(60))
def test_a_chain_says_what_its_blocks_say(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 5, 20, 100])
    sizes = [[rng.choice([0, 0, rng.randint(0, limit), rng.randint(0, max(1, limit // 9)), rng.randint(0, limit * 2)]) for _ in range(rng.randint(1, 15))] for _ in range(rng.randint(1, 9))]
    blocks = [summarise(np.array(s, np.int64), limit) for s in sizes]
    cut = rng.randint(0, len(blocks))
    whole = chain([chain(part, limit) for part in (blocks[:cut], blocks[cut:]) if part], limit)
    for fill, bins in [(0, 0), *((f, 3) for f in range(0, 2 * limit + 2, max(1, limit // 7)))]:
        want = (fill, bins)
        for block in blocks:
            want = enter(*block, limit, *want)
        assert enter(*whole, limit, fill, bins) == want


def test_frame(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([0, 1, 5, 9, None, 30]), "x") for g in ("a", "b", None) for i in range(200 if g == "a" else 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, n int, block string")
    out = greedy_bins(df, ["g"], ["i"], "n", 20, block=16).collect()
    assert len(out) == len(rows)
    for g in ("a", "b", None):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.i)
        assert [r.bin for r in mine] == plain([r.n or 0 for r in mine], 20)
    deep = greedy_bins(df, ["g"], ["i"], "n", 20, block=3, fan=3).collect()
    assert sorted((r.g or "", r.i, r.bin) for r in deep) == sorted((r.g or "", r.i, r.bin) for r in out)
    assert greedy_bins(df.limit(0), ["g"], ["i"], "n", 20).count() == 0
