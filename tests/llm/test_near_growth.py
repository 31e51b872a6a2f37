import numpy as np

from lexmill.llm import near


def corpus(rows, seed=4):
    """Flat word hashes and sizes: each record five of 60 sentences of common words, and five words of its own kind."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    sentences = [rng.choice(common, 9, replace=False) for _ in range(60)]
    rare = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    return [np.unique(np.concatenate([*(sentences[i] for i in rng.choice(60, 5, replace=False)), rng.choice(rare, 5)])) for _ in range(rows)]


def flat(sets):
    n = np.array([len(s) for s in sets])
    return np.concatenate(sets), n


def keys(orders, sets):
    hs, n = flat(sets)
    return orders.keys(hs, np.cumsum(n) - n)


def met(rows):
    """Pairs in blocks a record."""
    sets = corpus(rows)
    _, k = keys(near.Orders.learn(*flat(sets)).for_rows(rows), sets)
    c = np.unique(k >> np.uint64(near.SIZE_BITS), return_counts=True)[1].astype(np.int64)
    return (c * (c - 1) // 2).sum() / rows


def test_blocks_do_not_grow_with_the_table():
    # keys of five words each gave four times as many pairs a record in a table four times as large
    assert met(16_000) < 2 * met(4_000)


def test_long_keys_still_meet():
    rng = np.random.default_rng(8)
    sets = corpus(1500)
    other = corpus(1500, seed=9)
    edited = []
    for s, o in zip(sets, other):
        r = int(0.3 * len(s) / 1.7)  # as far apart as a pair may be
        edited.append(np.r_[rng.permutation(s)[r:], np.setdiff1d(o, s)[:r]])
    learned = near.Orders.learn(*flat(sets))
    for rows in (1500, 30_000_000):
        orders = learned.for_rows(rows)
        a, b = ({*zip(*(x.tolist() for x in keys(orders, s)))} for s in (sets, edited))
        assert len({who for who, _ in a & b}) >= 0.995 * len(sets)


def test_ranges():
    got = [(i, j) for x, y in near._ranges(np.array([5, 6, 9, 1]), np.array([3, 0, 1, 2]), 3) for i, j in zip(x.tolist(), y.tolist())]
    assert got == [(0, 5), (0, 6), (0, 7), (2, 9), (3, 1), (3, 2)]
