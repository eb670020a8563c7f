"""Periodic runs, hard negatives and toxicity against brute force, with odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillgrid.llm import periodic_runs, toxicity
from tillgrid.llm.hard_negatives import exact_scores, hard_negatives, primes, residues
from tillgrid.llm.periodic_runs import PRIME, find_runs, inverse, occurrences, reduced, runs_of, transform
from tillgrid.llm.textblocks import text_blocks


@pytest.mark.parametrize("size", [2, 4, 32, 64, 4096])
def test_transform_is_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-50, 50, (3, size)).astype(float)
    scale = pow(size, PRIME - 2, PRIME)
    assert (reduced(inverse(transform(x)) * (scale if scale < PRIME / 2 else scale - PRIME)) == x).all()


def test_occurrences():
    rng = np.random.default_rng(5)
    for block in (1, 2, 8, 64):
        codes = rng.integers(0, 2, 2_000)
        codes[700:900] = codes[800:1000]
        starts = np.arange(0, 1_500, block)
        at, far = occurrences(codes, starts, block, block)
        want = {(x, d) for x in starts for d in range(block, 2 * block) if (codes[x : x + block] == codes[x + d : x + d + block]).all()}
        assert set(zip(at.tolist(), far.tolist())) == want


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            inside = any(q % p == 0 and s <= i and s + n >= i + length for s, n, p in out)
            if length >= max(6, 4 * q) and not inside:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng, kinds, count=60):
    for _ in range(count):
        words = [f"w{x}" for x in rng.integers(0, kinds, int(rng.integers(0, 90)))]
        while words and rng.random() < 0.6:
            at, size, period = (int(rng.integers(n)) for n in (len(words), 150, 20))
            root = words[at : at + period + 1]
            words[at : at + 3] = [root[i % len(root)] for i in range(size)]
        yield words


@pytest.mark.parametrize("largest", [1 << 19, 4])
def test_runs(monkeypatch, largest):
    monkeypatch.setattr(periodic_runs, "LARGEST_BLOCK", largest)
    rng = np.random.default_rng(7)
    for kinds in (1, 2, 3, 30):
        texts = list(periodic_texts(rng, kinds))
        number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        words = (np.array([number[w] for t in texts for w in t], np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        assert [tuple(r) for r in runs_of(words, bounds).tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_find_runs(make):
    rng = np.random.default_rng(3)
    texts = [" \n".join(t) + " " for t in periodic_texts(rng, 4)]
    texts += [None, "", " \t", "one", "a " * 5, "a " * 6, "é ü " * 9, "x y z " * 40_000 + "end"]
    rows = list(enumerate(texts)) + [(None, "b " * 8), (0, texts[0])]
    got = find_runs(make(rows)).collect()
    want = Counter()
    for i, text in rows:
        words = (text or "").split()
        runs = plain_runs(words) if len(words) < 10_000 else [(0, 120_000, 3)]
        gone = {j for s, n, p in runs for j in range(s + p, s + n)}
        want[(i, tuple(runs), " ".join(w for j, w in enumerate(words) if j not in gone))] += 1
    assert Counter((r.id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == want
    assert find_runs(make([])).count() == 0


@pytest.mark.parametrize("size", [1, 130])
@pytest.mark.parametrize("most", [1, 300, 10**9, 10**30])
def test_residue_products(size, most):
    rng = np.random.default_rng(2)
    a, b = (np.rint(rng.uniform(-1, 1, (n, size)) * most) for n in (5, 7))
    moduli = primes(size * (most + 1) ** 2)
    got = exact_scores([residues(a, p) for p in moduli], [residues(b, p) for p in moduli], moduli)
    whole = lambda m: [[int(x) for x in row] for row in m]
    assert got.tolist() == [[sum(x * y for x, y in zip(r, s)) for s in whole(b)] for r in whole(a)]


def plain_negatives(rows, every):
    fine = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(256 * x) for x in v], label))
    out = Counter()
    for a, v, label in fine:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, w, own in fine if i != a)
        for s, i, own in [r for r in scored if r[2] == label][:5]:
            found = [(-t, j) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
            out.update((a, i, r, j, long(-s), long(t)) for r, (t, j) in enumerate(found[:3], 1))
    return out


@pytest.mark.parametrize("scale", [1.0, 2e6, 1e30])
@pytest.mark.parametrize("sizes", [(8192, 256), (9, 3)])
def test_hard_negatives(spark, scale, sizes):
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    rows = [(i, [float(np.float32(x * scale)) for x in base + rng.normal(size=6)], int(rng.integers(3))) for i in range(70)]
    rows += [(70 + i, rows[3][1], i % 3) for i in range(9)]  # ties
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 0), (None, rows[0][1], 1)]
    rows += [(204, rows[5][1], None), (205, [0.5], 2), (210, [], 1), (215, [0.0] * 6, 0), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("rank", "key", "place")})
    got = hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=sizes[0], slab_rows=sizes[1])
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives(rows, 5)


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 1)], [(5, [1.0], 1)], [(5, [1.0], 1), (6, [1.0], 1)], [(5, [1.0], 1), (6, [1.0], 2)]):
        assert hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 5 == 0).count() == 0


def plain_kernel(a, b):
    def ends(p):  # weight of common subsequences of p letters that end at each pair of places
        if p == 1:
            return {(i, j): toxicity.DECAY**2 for i, x in enumerate(a) for j, y in enumerate(b) if x == y}
        out = defaultdict(float)
        for (i, j), w in ends(p - 1).items():
            for k in range(i + 1, len(a)):
                for m in range(j + 1, len(b)):
                    if a[k] == b[m]:
                        out[(k, m)] += w * toxicity.DECAY ** (k - i + m - j)
        return out

    return sum(ends(toxicity.ORDER).values())


def test_subsequence_kernel():
    pairs = [("idiot", "idiot"), ("idxiot", "idiot"), ("stupid", "stoopid"), ("abcd", "dcba"), ("aaaaaa", "aaaaa"), ("été", "été"), ("réeuxment", "réeux")]
    a, b = (toxicity.as_codes(list(x)) for x in zip(*pairs))
    want = [plain_kernel(x[x > 0].tolist(), y[y > 0].tolist()) for x, y in zip(a, b)]
    assert np.allclose(toxicity.kernel(a, b), want, rtol=1e-4)
    # Leaving pairs out by their letters leaves out zeros only.
    marks = toxicity.Landmarks(b)
    whole = np.array([[toxicity.kernel(x[None], y[None])[0] for y in b] for x in a])
    assert np.allclose(marks.compare(a)[:, : len(b)], (whole / marks.own) ** toxicity.POWER, rtol=1e-4)


def test_units():
    texts = ["So, an i.d.i.o.t or a n i d i o t! Dis-gusting people.", None, "", "a b", "word " * 300, "x" * 60]
    (block,) = text_blocks(pa.array(texts))
    found = toxicity.units(block)
    of = np.searchsorted(found.bounds, found.sentence, "right") - 1
    said = [[found.text(i) for i in np.flatnonzero(of == t)] for t in range(len(texts))]
    assert said[0] == ["idiot", "anidiot", "disgusting", "people"] and said[1] == said[2] == said[3] == []
    assert said[4] == ["word"] * 300 and len(set(found.sentence[of == 4])) == 3
    assert [len(u) for u in said[5]] == [24, 25, 25, 25]  # windows after the first are marked


INSULTS = ["dolt", "numbskull", "buffoon"]


def chatter(rng, toxic):
    words = ["".join(rng.choice(["ba", "ren", "to", "mi", "sul", "ka", "of"], int(rng.integers(1, 4)))) for _ in range(40)]
    if toxic:
        words[int(rng.integers(40))] = str(rng.choice(INSULTS))
    words[19] += "."
    return " ".join(words)


def test_toxicity(make):
    rng = np.random.default_rng(12)
    rows = [(i, chatter(rng, i % 4 == 0), "en", str(int(i % 4 == 0)), 1) for i in range(600)]
    train = make(rows)
    model = toxicity.fit(train, F.col("source"))
    again = toxicity.fit(train, F.col("source"))
    assert np.allclose(model.weights, again.weights)
    fresh = [(i, chatter(rng, i % 2 == 0)) for i in range(200)]
    got = {r.doc_id: r.score for r in toxicity.score(make(fresh), model, keep=[F.col("doc_id")]).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (i % 2 == 0) for i in got]) > 0.97
    clean = chatter(rng, False)
    bent = [clean + " " + w for w in ("n u m b s k u l l", "b.u.f.f.o.o.n", "numbxskull", "bufffoon")]
    odd = [None, "", "12 !", clean, *bent, (clean + " ") * 5_000, (clean + " ") * 5_000 + "dolt"]
    found = [r.score for r in toxicity.score(make(list(enumerate(odd)) + [(None, clean)]), model, keep=[F.col("doc_id")]).orderBy(F.asc_nulls_last("doc_id")).collect()]
    assert found[0] == found[1] == found[2] < 0.5 and found[3] == pytest.approx(found[-1], abs=1e-3) and found[3] < 0.5
    assert min(found[4:8]) > 0.7 and found[8] < 0.5 and found[9] > 0.7
    assert toxicity.score(make([]), model).count() == 0


def test_toxicity_of_few_labels(make):
    for rows, share in (([], 0.5), ([(1, "one text", "en", "1", 1)], 2 / 3), ([(1, "one text", "en", None, 1)], 0.5)):
        model = toxicity.fit(make(rows), F.col("source"))
        assert [r.score for r in toxicity.score(make([(1, "some words"), (2, None)]), model).collect()] == pytest.approx([share] * 2)


def test_logistic_and_support_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=400) > 0.5, 1, -1)
    w, bias = toxicity.support_vectors(x, y, np.ones(400))
    assert np.mean(np.sign(x @ w + bias) == y) > 0.9
    slope, intercept = toxicity.logistic(x @ w + bias, (y > 0).astype(int), np.ones(400))
    p = 1 / (1 + np.exp(-(slope * (x @ w + bias) + intercept)))
    assert slope > 0 and abs(p.mean() - (y > 0).mean()) < 0.02
