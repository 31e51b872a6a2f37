import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import history, near

VOCAB = [f"w{i}" for i in range(400)]


def make_rows(seed=1, families=12):
    """(row_no, id, title, body, batch): families of edited, moved and repeated texts, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(14, 60))]
        for k in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            if k % 2:
                rng.shuffle(w)
            rows.append([f"doc-{rng.randrange(40):05d}", " ".join(w[:3]).title(), " ".join(w[3:]), rng.randint(0, 3)])
    rows += [["doc-00001", None, None, 0], [None, "", "", 1], [None, None, "a b c", 2], ["x", "short", "text", 1], ["DOC 1", "", "y " * 50, 2]]
    rng.shuffle(rows)
    rows.append(["long", "t", " ".join(VOCAB * 60), 1])
    rows.append(["long2", "t", " ".join(VOCAB * 30), 2])
    return [(i, *r) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_no long, id string, title string, body string, batch int").withColumn("k", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("hs", F.lit(1))


def words(r):
    return {w.lower() for w in f"{r[2] or ''} {r[3] or ''}".split()}


def alike(rows):
    sets = [(r[0], words(r)) for r in rows if len(words(r)) >= 12]
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if len(x & y) / len(x | y) >= 0.7}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_groups(spark, seed):
    rows = make_rows(seed)
    want = alike(rows)
    df = frame(spark, rows)
    assert {(r.a, r.b) for r in near.near_pairs(df, "row_no", "title", "body").collect()} == want
    groups = {r["row"]: (r["class"], r["group"]) for r in near.near_groups(df, "row_no", "title", "body").collect()}
    assert set(groups) == {r[0] for r in rows if len(words(r)) >= 12}
    top = {r: r for r in groups}
    changed = True
    while changed:
        changed = False
        for a, b in want:
            m = min(top[a], top[b])
            changed |= top[a] != m or top[b] != m
            top[a] = top[b] = m
    assert {r: g[1] for r, g in groups.items()} == top
    same = {r[0]: frozenset(words(r)) for r in rows}
    for r, (cls, _) in groups.items():
        assert cls == min(x for x in groups if same[x] == same[r])


def test_empty_and_pivot_bound(spark):
    df = frame(spark, make_rows()[:0])
    assert near.near_pairs(df, "row_no", "title", "body").count() == 0
    assert near.near_groups(df, "row_no", "title", "body").count() == 0
    rng = np.random.default_rng(3)
    hs = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    x, y = hs[:120], np.r_[hs[20:120], hs[150:190]]
    c = near.unpacked(near.pivot_table(np.r_[x, y], np.array([120, 140]))).astype(int)
    both = set(x.tolist()) ^ set(y.tolist())
    assert np.abs(c[0] - c[1]).sum() <= len(both)
    # the sum is the largest difference of distances over all unions of groups
    small = rng.integers(0, 6, (2, 8))
    unions = [[u >> g & 1 for g in range(8)] for u in range(256)]
    apart = max(abs(sum((small[0] - small[1]) * (1 - 2 * np.array(u)))) for u in unions)
    assert apart == np.abs(small[0] - small[1]).sum()


def crowd(n=90, words=40):
    """Many near copies of one text, far texts that share some words with them, and a text of its own."""
    rng = random.Random(5)
    base = [f"c{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        w[i % words] = f"x{i}"
        rows.append((i, "", " ".join(w)))
    rows += [(n + i, " ".join(rng.sample(base, 25)), " ".join(f"y{i}_{j}" for j in range(30))) for i in range(20)]
    return [*rows, (n + 20, "", " ".join(f"z{j}" for j in range(30)))]


@pytest.mark.parametrize("block", [8, 1024])
def test_large_and_hot_blocks(spark, monkeypatch, block):
    rows = crowd()
    df = spark.createDataFrame(rows, "row_no long, title string, body string").repartition(1)
    first = near.near_classes(df, "row_no", "title", "body")[1]
    want = {(a, b) for a in range(90) for b in range(a + 1, 90)}
    plain = {(r.a, r.b) for r in near.candidates(first, block=block).collect()}
    assert want <= plain and not any(b == 110 for _, b in plain)
    star = {(r.a, r.b) for r in near.candidates(first, star=True, block=block).collect()}
    assert {(0, b) for b in range(1, 90)} & star and len(star) < len(want)
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "SHARE", 4)
    assert near.hot_blocks(first)
    assert {(r.a, r.b) for r in near.candidates(first, block=block).collect()} == plain
    assert {(r.a, r.b) for r in near.candidates(first, star=True, block=block).collect()} >= star - {(a, b) for a, b in star if b >= 90}
    tagged = first.withColumn("tag", (F.col("row") % 2).cast("long"))
    assert {(r.a, r.b) for r in near.candidates(tagged, tag="tag", block=block).collect()} == {(a, b) for a, b in plain if (a - b) % 2}
    groups = {r["row"]: r["group"] for r in near.near_groups(df, "row_no", "title", "body").collect()}
    assert groups == {r[0]: 0 if r[0] < 90 else r[0] for r in rows}


def test_salted_pairs(spark):
    keyed = spark.createDataFrame([(k, r) for k, n in ((1, 40), (2, 3), (3, 1)) for r in range(n)], "k long, row long")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40)}
    for piece in (2, 7, 100):
        assert {(r.a, r.b) for r in near.salted_pairs(keyed, piece).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (150, 300), (7, 7)]
    got = {r.row: r.component for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 150: 100, 200: 100, 300: 100}


def test_id_keys(spark):
    same = [["doc-000001234", "DOC-1234", " doc 1234\n", "[doc-000001234]", "doc1234", "doc-000-001-234", "Ｄｏｃ-0000001234", "doc-００００１２３４", "Doc–1234", "doc#1234"], ["wiki/page/000000007", "Wiki.Page-7", "wikipage7"], ["doc-1235"], ["docs-1234"], ["doc-12340"], ["dóc-1234"]]
    flat = [(i, x) for i, xs in enumerate(same) for x in xs]
    got = spark.createDataFrame(flat, "g int, id string").select("g", history.id_key(F.col("id")).alias("k")).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, set()).add(r.g)
    assert len(by) == len(same) and all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("seed", [1, 4])
def test_repeated_rows(spark, seed):
    rows = make_rows(seed)
    pos = {r[0]: (r[4], r[0]) for r in rows}
    want = {max(a, b, key=pos.get) for a, b in alike(rows)}
    key = lambda i: None if i is None else int("".join(c for c in i if c.isdigit()) or 0) if i.lower().startswith("doc") else i
    for r in rows:
        if any(r[1] and q[1] and key(q[1]) == key(r[1]) and pos[q[0]] < pos[r[0]] for q in rows):
            want.add(r[0])
    want = {x for x in want if pos[x][0] >= 1}
    more = [(900, "doc-00001", "t", "no batch", None)]
    got = [r.row_no for r in history.repeated_rows(frame(spark, rows + more)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert history.repeated_rows(frame(spark, [])).count() == 0
    assert history.repeated_rows(frame(spark, [r for r in rows if r[4] == 0])).count() == 0


def test_slices_have_no_false_negatives():
    k = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 9000)
    f = history.Slices()
    for part in np.array_split(k, 7):
        f.add(part)
    again = history.Slices()
    for _, n, bits in f.rows():
        again.load(n, bits)
    assert len(again.bits) > 1 and sum(again.count) == 9000
    assert again.holds(k).all()
    assert again.holds(k + 1).mean() < 0.03


def test_winnow_guarantee():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, history.SHINGLE + history.WINDOW - 1, dtype=np.uint64)
    prints = []
    for _ in range(2):
        w = np.r_[rng.integers(0, 1 << 63, 9, dtype=np.uint64), shared, rng.integers(0, 1 << 63, 9, dtype=np.uint64)]
        prints.append(set(history.winnow(w, np.array([len(w)]))[1].tolist()))
    assert prints[0] & prints[1]
    rec, f = history.winnow(np.r_[shared, shared[:5], shared], np.array([8, 5, 8]))
    assert set(rec.tolist()) == {0, 2} and set(f[rec == 0].tolist()) == set(f[rec == 2].tolist())


def positions(spark, rows):
    return spark.createDataFrame(rows, "pos long, id string, title string, body string")


def text(i, n=40):
    rng = random.Random(i)
    return " ".join(f"v{rng.randrange(100000)}" for _ in range(n))


def test_store_opens_again_and_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "store")
    store = history.FingerprintStore(spark, path, parts=16)
    store.offer(positions(spark, [(i, f"a-{i}", "t", text(i)) for i in range(300)]), check=False)
    # a batch that failed half-way: its folder is there, its commit is not
    (tmp_path / "store" / "prints" / "seg=000001").mkdir(parents=True)
    again = history.FingerprintStore(spark, path)
    assert again.parts == 16 and again.segments == ["000000"]
    small = positions(spark, [(1000, "A_007", "", "new"), (1001, None, "t", text(5)), (1002, "b", "t", text(7000)), (1003, None, "T", text(7000) + " end")])
    assert {r.pos for r in again.offer(small).collect()} == {1000, 1001, 1003}
    third = history.FingerprintStore(spark, path)
    assert third.segments == ["000000", "000001"]
    assert third.offer(positions(spark, [])).count() == 0
    # one repeated row: only the partitions of its own fingerprints and of their owners are read
    assert {r.pos for r in third.offer(positions(spark, [(2000, "c", "t", "only a few words " + "a b c")])).collect()} == set()
    assert len(third.last_read[0]) <= 1 and len(third.last_read[1]) <= 1
    assert {r.pos for r in third.offer(positions(spark, [(2001, "a-9", "t", "short")])).collect()} == {2001}
    assert len(third.last_read[0]) <= 2 and len(third.last_read[1]) == 1


def test_hot_group_in_a_batch(spark, monkeypatch):
    monkeypatch.setattr(history, "PIECE", 10)
    rows = [(i, f"h-{i}", t, b) for i, t, b in crowd()]
    store = history.FingerprintStore(spark, parts=4)
    store.offer(positions(spark, rows[:1]), check=False)
    assert {r.pos for r in store.offer(positions(spark, rows[1:])).collect()} == set(range(1, 90))
