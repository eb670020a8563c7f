"""Exact, near and substring dedup against brute force, with odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillgrid.llm import substring_dedup
from tillgrid.llm.components import components
from tillgrid.llm.exact_dedup import exact_dedup, exact_groups
from tillgrid.llm.near_dedup import circulant, near_dedup, near_groups, signature
from tillgrid.llm.substring_dedup import CELL, _units, _walks, remove_repeats
from tillgrid.llm.textblocks import mix

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, periodic, empty, null, short and long texts."""
    rng = np.random.default_rng(5)
    base = [text(rng, int(n)) for n in rng.integers(20, 120, 12)]
    passage = text(rng, 30)
    rows = list(base)
    rows += [base[0], base[0].replace(" ", "\n\t"), base[0].upper()]
    for b in base[:4]:
        words = b.split()
        for _ in range(4):
            near = list(words)
            near[int(rng.integers(len(near)))] = "changed"
            rows.append(" ".join(near))
    rows += [f"{text(rng, 15)} {passage} {text(rng, 9)}" for _ in range(4)]
    rows += ["again " * 40, "again " * 60, "", None, " \n ", "one", "ONE", "two words", "é Ünï code  x " * 9]
    rows.append(" ".join(text(rng, 50) for _ in range(60)))
    rng.shuffle(rows)
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)) * 3, rows)]


def words_of(t, lower=False):
    data = (t or "").encode()
    if lower:
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    return data.split()


def test_exact_groups(make, corpus):
    got = {r["id"]: r for r in exact_groups(make(corpus)).collect()}
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in corpus}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), i == min(same))
        assert r["digest"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_compares_texts_where_digests_collide(make, corpus):
    plain = {r["id"]: r["keep_id"] for r in exact_groups(make(corpus)).collect()}
    poor = exact_groups(make(corpus), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    assert {r["id"]: r["keep_id"] for r in poor.collect()} == plain


def test_exact_odd_rows(make):
    rows = [(7, "x"), (7, "x"), (None, "x"), (None, "y"), (None, "y"), (3, None), (2, "")]
    got = sorted(exact_groups(make(rows)).select("id", "keep_id", "group_size", "kept").collect(), key=repr)
    assert Counter(tuple(r) for r in got) == Counter(
        [(7, 7, 3, True), (7, 7, 3, False), (None, 7, 3, False), (None, None, 2, True), (None, None, 2, False), (3, 2, 2, False), (2, 2, 2, True)]
    )
    kept = exact_dedup(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(2, ""), (7, "x"), (None, "y")]
    assert exact_groups(make([])).count() == exact_dedup(make([])).count() == 0


def brute_components(corpus, size, percent):
    sets = {}
    for i, t in corpus:
        w = words_of(t, True)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups(make, corpus, size):
    got = {r[0]: tuple(r)[1:] for r in near_groups(make(corpus), size=size).collect()}
    assert got == brute_components(corpus, size, 80)


def test_near_groups_in_buckets_of_many_components(make, corpus):
    """With bands of one coordinate nearly everything shares buckets, and all rounds of pivots are needed."""
    got = {r[0]: tuple(r)[1:] for r in near_groups(make(corpus[:30]), size=2, bands=12, band_rows=1).collect()}
    assert got == brute_components(corpus[:30], 2, 80)


def test_near_odd_rows(make):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A b C d e f"), (9, None), (8, "")]
    got = Counter(tuple(r) for r in near_groups(make(rows)).collect())
    assert got == Counter([(5, 2, 2, False), (5, 2, 2, False), (None, 2, None, True), (2, 2, 2, True), (9, 0, 9, True), (8, 0, 8, True)])
    kept = near_dedup(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 8, 9, None]
    assert near_groups(make([])).count() == 0


def test_signature_is_circulant():
    shingles = mix(np.arange(1, 4000, dtype=np.uint64))
    width = 64
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(int)
    order = circulant(width)[:, 0]
    slow = [min(order[(p + k) % len(order)] for p in places) for k in range(width)]
    assert list(signature(shingles, width)) == slow
    half = signature(shingles[: len(shingles) // 2], width)
    assert 0.3 < (half == signature(shingles, width)).mean() < 0.7


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def brute_removal(rows, k):
    first = {}
    for i, t in sorted(rows):
        w = words_of(t)
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_substring_dedup(make, corpus):
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(make(corpus), with_text=True).collect()}
    assert got == brute_removal(corpus, 13)
    assert sum(n for _, n, *_ in got.values()) > 500


@pytest.mark.parametrize("k, gram", [(3, 1), (4, 4)])
def test_substring_dedup_of_short_windows(make, corpus, k, gram):
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(make(corpus), k=k, gram=gram, with_text=True).collect()}
    assert got == brute_removal(corpus, k)


@pytest.mark.parametrize("bits", [4, 7])
def test_substring_words_decide(make, corpus, bits):
    """Words that share fingerprints make false pieces and edges; the answer is that of the words."""
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(make(corpus), with_text=True, bits=bits).collect()}
    assert got == brute_removal(corpus, 13)


def test_substring_paths_are_compacted(spark):
    """Paths over (doc, part, pos, n, head, tail): a chain is one unit, a branch and a cell's end begin another."""
    rows = [(1, 0, p, 1, p, p + 1) for p in range(6)] + [(2, 0, 0, 1, 3, 99)]  # node 3 has two ways out
    rows += [(3, 0, CELL - 1, 1, 200, 201), (3, 0, CELL, 4, 201, 202), (3, 0, CELL + 4, 1, 202, 203)]
    rows += [(4, 0, 0, 1, 300, 301), (5, 0, 7, 1, 301, 302)]  # one way on, but in another document
    paths = spark.createDataFrame(rows, "doc long, part long, pos long, n long, head long, tail long")
    got = {}
    for r in _units(paths).collect():
        got.setdefault(r.unit, set()).add((r.doc, r.pos, r.off))
    assert sorted(map(sorted, got.values())) == [
        [(1, 0, 0), (1, 1, 1), (1, 2, 2)],
        [(1, 3, 0), (1, 4, 1), (1, 5, 2)],
        [(2, 0, 0)],
        [(3, CELL - 1, 0)],
        [(3, CELL, 0), (3, CELL + 4, 4)],
        [(4, 0, 0)],
        [(5, 7, 0)],
    ]


def test_substring_joins(make, corpus, plan, monkeypatch):
    """Straight paths and windows keep the unit they get, with no further joins; a join may hash its smaller side."""
    spark, key = make([]).sparkSession, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before, joins, limits = spark.conf.get(key), [], set()
    plain = substring_dedup.settle

    def watched(df):
        joins.extend(re.findall(r"(?:SortMerge|ShuffledHash|BroadcastHash)Join", plan(df)))
        limits.add(spark.conf.get(key))
        return plain(df)

    monkeypatch.setattr(substring_dedup, "settle", watched)
    remove_repeats(make(corpus[:30]))
    assert len(joins) == 10
    assert limits == {"32m"} and spark.conf.get(key) == before


def test_substring_walks_of_split_pieces():
    """Edges in any order within their piece; a piece that a batch cuts in two stands in two rows."""
    rows = [(1, 0, 0, b, 9, 5 + b, 1) for b in (2, 0, 1, 4)] + [(1, 0, 8, 0, 9, 0, 1), (1, 0, 8, 1, 7, 3, 2)]
    names = ["doc", "part", "start", "begin", "unit", "off", "first"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    got = [(r["start"], [tuple(x.values()) for x in r["way"]]) for b in _walks([batch[:5], batch[5:]]) for r in b.to_pylist()]
    assert got == [(0, [(0, 3, 9, 5, 1), (4, 1, 9, 9, 1)]), (8, [(0, 1, 9, 0, 1)]), (8, [(1, 1, 7, 3, 2)])]


def test_substring_long_text(make):
    """A text of many cells, its copy with one word changed, and a passage from its middle."""
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in rng.integers(0, 3000, 3 * CELL)]
    other = [*words[: CELL + 5], "changed", *words[CELL + 6 :]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x y " + " ".join(words[CELL - 20 : CELL + 40]))]
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(make(rows), with_text=True).collect()}
    assert got == brute_removal(rows, 13)
    assert got[2][1] == len(words) - 1 and got[3][1] == 60


def test_substring_odd_rows(make):
    a, b = " ".join(WORDS[:20]), " ".join(WORDS[50:70])
    rows = [(4, a), (4, b), (4, a), (None, a), (6, f"{a} {b}"), (1, None)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(make(rows)).collect())
    assert got == Counter([(4, 20, 0), (4, 20, 0), (4, 20, 0), (None, 20, 0), (6, 40, 40), (1, 0, 0)])
    assert remove_repeats(make([])).count() == 0
