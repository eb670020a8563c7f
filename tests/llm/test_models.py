"""Language ID, class model, top-k and chat formatting against brute force, with odd rows."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tillgrid.llm.chat_tree import END, START, format_conversations, read_back, read_nodes
from tillgrid.llm.class_lm import best_classes, exchange, grown, likelihood, novel, score_texts, unseen_types
from tillgrid.llm.language_id import fit, ftrl, identify, temperature
from tillgrid.llm.top_k import top_inner_products

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOUNDS = {"one": ["ka", "ko", "ri", "mu"], "two": ["schl", "eich", "ung", "ver"], "three": ["ção", "ões", "lhe", "que"]}


def speech(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang], int(rng.integers(1, 4)))) for _ in range(words))


def test_language_id(make):
    rng = np.random.default_rng(0)
    langs = [list(SOUNDS)[i % 3] for i in range(240)]
    rows = [(i, speech(rng, lang, int(rng.integers(3, 60))), lang, "s", 1) for i, lang in enumerate(langs)]
    df = make(rows, clash=False)
    model = fit(df.where("doc_id % 4 <> 2"), "text", "lang", "doc_id", per_language=50)
    assert model.languages == sorted(SOUNDS) and model.temperature > 0
    assert (model.weights == 0).mean() > 0.9
    got = identify(df, model, keep=[F.col("doc_id"), F.col("lang")]).collect()
    held = [r for r in got if r.doc_id % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = make([(1, None), (2, ""), (3, "12 !? 3"), (None, "ka ri"), (4, "x"), (5, "schlung " * 30_000)])
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd, model, keep=[F.col("doc_id")]).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[5][0] == "two" and found[4][0] in SOUNDS and found[None][0] == "one"
    assert identify(make([]), model).count() == 0


def test_language_id_without_labels(make):
    model = fit(make([(1, "text", None, "s", 1)]), "text", "lang", "doc_id")
    assert identify(make([(1, "text")]), model).select("lang_pred", "score").collect() == [("und", 0.0)]
    one = fit(make([(1, "text", "en", "s", 1)]), "text", "lang", "doc_id")
    assert identify(make([(1, "other")]), one).first()["lang_pred"] == "en"


def test_rows_that_share_an_id_are_drawn_by_text(make):
    rng = np.random.default_rng(7)
    rows = [(None, speech(rng, "one", 12), "en", "s", 1) for _ in range(400)]
    rows += [(i, speech(rng, "two", 12), "de", "s", 1) for i in range(40)] + [(7, "ção ões lhe", "pt", "s", 1)] * 300
    df = make(rows, clash=False)
    model = fit(df, "text", "lang", "doc_id", per_language=30)
    got = identify(df, model, keep=[F.col("lang")]).collect()
    assert model.languages == ["de", "en", "pt"] and np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_penalties_and_temperature():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 200)
    examples = [(np.array([0, 1 + int(rng.integers(50))]), np.array([float(y) + 0.1, 0.01])) for y in labels]
    loose, _ = ftrl(examples, labels, 2, l1=0.0)
    tight, _ = ftrl(examples, labels, 2, l1=0.5)
    assert (tight != 0).sum() < (loose != 0).sum()
    logits = np.stack((np.zeros(200), np.where(labels, 8.0, -8.0) * np.where(rng.random(200) < 0.2, -1, 1)), axis=1)
    assert temperature(logits, labels) > 2  # one in five is wrong, so certainty must go


def test_class_model(make):
    rng = np.random.default_rng(3)
    rows = [(i, speech(rng, list(SOUNDS)[i % 3], 40)) for i in range(120)]
    rows += [(120, None), (121, ""), (122, "KA ka"), (122, "KA ka"), (None, "never seen this"), (124, " \n")]
    df = make(rows)
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(True))
    for head, classes in ((1 << 17, 48), (20, 3)):
        got = score_texts(df, held, head=head, class_words=15, classes=classes).collect()
        tokens = [(i, [w.lower() for w in (t or "").split()] + [None]) for i, t in rows]
        count = Counter(w for i, ws in tokens if i is not None and i % 5 for w in ws)
        total, kinds = sum(count.values()), len(count)
        want = Counter()
        for i, ws in tokens:
            base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
            want[(i, i is None or i % 5 == 0, len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6))] += 1
        assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
        out = [r for r in got if r.held_out and r.n_tokens > 3]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_model_sums_to_one(make):
    """Starts, transitions and ends, solved from the scores of all texts of at most two words, leave nothing over."""
    train = [(1, "a b a b c"), (2, "a b d"), (3, "b a e e e e f"), (4, "a a a a b b b b g g")]
    words = [*"abcdefg", "unseen"]
    asked = [(100, ""), *((101 + i, w) for i, w in enumerate(words))]
    asked += [(200 + i * len(words) + j, f"{v} {w}") for i, v in enumerate(words) for j, w in enumerate(words)]
    for head in (3, 1 << 17):
        df = score_texts(make(train + asked), F.col("doc_id") >= 100, head=head, class_words=2, classes=2)
        got = {r.doc_id: 10**r.score for r in df.collect()}
        one = np.array([got[101 + i] for i in range(len(words))])
        two = np.array([got[200 + i] for i in range(len(words) ** 2)]).reshape(len(words), -1)
        kinds = np.array([1.0] * 7 + [novel(3, 1, 4)[1]])  # c, d and f stand once, g twice
        step = two / one
        starts = np.linalg.solve(np.eye(len(words)) - step * kinds, one)  # every word's ways on and its end sum to one
        assert abs(got[100] + (starts * kinds).sum() - 1) < 1e-9
        assert one[-1] <= one[:-1].min() + 1e-12  # an unseen word is no likelier than a learned one


def test_class_model_is_the_same_for_every_head(make):
    """Common words beyond those that all tasks know get their class by joins, as neighbours too."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    weight = 1 / (np.arange(300) + 5.0)
    rows = [(i, " ".join(rng.choice(words[i % 2 :: 2], 60, p=weight[i % 2 :: 2] / weight[i % 2 :: 2].sum()))) for i in range(90)]
    df, held = make(rows), F.col("doc_id") % 10 == 0
    scores = [
        {r.doc_id: r.score for r in score_texts(df, held, head=head, class_words=12, classes=4).collect()} for head in (12, 40, 1 << 17)
    ]
    for other in scores[1:]:
        assert scores[0].keys() == other.keys()
        assert max(abs(scores[0][i] - other[i]) for i in other) < 1e-9


def test_unseen_types_and_likelihood():
    assert unseen_types(0, 0) == 1 and unseen_types(10, 4) == 9
    assert novel(10, 4, 20) == (10 / 18, 25) and novel(400, 10, 500)[1] > 7_000
    mixed, apart = np.array([[5.0, 5], [5, 5]]), np.array([[0.0, 10], [10, 0]])
    assert likelihood(apart) > likelihood(mixed)


def test_class_model_without_training(make):
    got = score_texts(make([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    assert score_texts(make([]), F.lit(True)).count() == 0


def test_exchange_finds_classes():
    """Even words are followed by odd ones and odd by even: two classes say it all."""
    rng = np.random.default_rng(2)
    pairs = np.zeros((21, 21))
    for a in range(20):
        for b in range(20):
            if (a + b) % 2:
                pairs[a, b] = rng.integers(50, 100)
    of = exchange(pairs, 20, 2, rounds=10)
    assert len(set(of[0:20:2])) == 1 and len(set(of[1:20:2])) == 1 and of[0] != of[1] and of[20] == 2


def test_rare_words_join_the_learned_classes():
    """Words outside the core go where their neighbours say, and leave their own class out of the account."""
    grid = np.array([[0.0, 500, 5], [500, 0, 5], [5, 5, 0]])  # classes that take turns, and the end
    contexts, counts = np.array([2, 3, 0, 1, 2, 3]), np.array([3, 3, 3, 3, 3, 3])
    for of in ([-1, -1, -1], [1, -1, 0]):
        got = best_classes(grid, 2, np.array(of), np.array([0, 2, 4]), contexts, counts)
        assert got.tolist() == [0, 1, 0]


def test_classes_grow_with_the_vocabulary():
    assert grown(100) == (1024, 48) and grown(10**6) == (1024, 100) and grown(10**8)[0] > 3_000


def turn_taking():
    """Two kinds of words take turns; words of both kinds and of equal counts stand outside the core."""
    rng = np.random.default_rng(11)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "xy"]
    rows = []
    for d in range(400):
        at = [rng.choice(kinds[(d + j) % 2], p=np.r_[np.full(4, 0.2), np.full(36, 0.2 / 36)]) for j in range(24)]
        rows.append((d, " ".join(at)))
    return rows


@pytest.mark.parametrize("head", [1 << 17, 30, 8])
def test_class_model_knows_words_outside_the_core(make, head):
    """Every step of a text but its words is known: about 0.3 for a change of kind lost in bands by count."""
    rows = turn_taking()
    got = score_texts(make(rows), F.col("doc_id") >= 360, head=head, class_words=8, classes=2).collect()
    count = Counter(w for i, t in rows if i < 360 for w in t.split())
    size = Counter()
    for w, n in count.items():
        size[w[0]] += n
    texts = dict(rows)
    for r in got:
        if r.held_out and all(count[w] >= 4 for w in texts[r.doc_id].split()):
            known = sum(math.log10(count[w] / size[w[0]]) for w in texts[r.doc_id].split())
            assert abs(r.score - known) < 3.2  # two ends of a text, and the smoothing of 24 steps


def brute_top(rows, k, every=3):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, v in fine:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
            out.update((q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores[:k], 1))
    return out


@pytest.mark.parametrize("blocks", [(2048, 512), (7, 4)])
@pytest.mark.parametrize("most", [1.0, 2e6, 1e30])
def test_top_k(spark, blocks, most):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 9]) * most).astype(np.float32).tolist()) for i in range(80)]
    rows += [(80 + i, rows[3][1]) for i in range(12)]  # ties
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(204, [0.5, 0.5]), (207, []), (210, [0.0] * 6), (213, [2.0**19] * 6), (214, [-(2.0**19)] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = top_inner_products(df, F.col("vec_id") % 3 == 0, block_rows=blocks[0], query_rows=blocks[1])
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, 5)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    asks = F.col("vec_id") % 3 == 0
    assert top_inner_products(spark.createDataFrame([], schema), asks).count() == 0
    assert top_inner_products(spark.createDataFrame([(1, [1.0])], schema), asks).count() == 0
    assert top_inner_products(spark.createDataFrame([(3, [1.0])], schema), asks).count() == 0
    rows = [(3, [1.0]), (3, [2.0]), (4, [1.0])]
    got = top_inner_products(spark.createDataFrame(rows, schema), asks).collect()
    assert Counter(tuple(r) for r in got) == brute_top(rows, 5)


CHAT = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def chats():
    rng = np.random.default_rng(8)
    starts = [[("system", "be kind"), ("user", "hi")], [("system", "be kind")], [("user", "hi")]]
    odd = ["", None, f"{END}{START}assistant ok", "<\\|x|> <\\\\| <|", "line\nline", "é日本 "]
    rows = []
    for c in range(30):
        said = list(starts[c % 3]) + [("assistant", f"yes {c % 4}"), ("user", odd[c % 6])]
        said += [("assistant" if j % 2 else "user", f"t{int(rng.integers(3))}") for j in range(int(rng.integers(0, 6)))]
        rows += [(c, j, role, text) for j, (role, text) in enumerate(said)]
    rows += [(50, 0, "user", "hi"), (51, 0, "user", "hi"), (51, 0, "user", "hi"), (52, None, None, None), (52, 1, "ro%0Ale\n<|x", "assistant")]
    rows += [(None, 1, "assistant", "b"), (None, 0, "user", "a")] + [(60, t, "assistant", f"n{t}") for t in range(600)]
    return rows


def test_chat_round_trip(spark, chats):
    df = spark.createDataFrame(chats, CHAT).withColumns({c: F.lit("x") for c in ("depth", "conv", "cell", "tree")})
    nodes, paths = format_conversations(df, PATH)
    got = {r.conv_id: r for r in read_back(nodes, paths, PATH).collect()}
    want = {}
    for c, t, role, text in sorted(chats, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, said in want.items():
        assert got[c].n_turns == len(said)
        assert got[c].turns == "".join(f"{r}\n{t}\n" for r, t in said)
        assert got[c].loss == "".join(t for r, t in said if r == "assistant")
    # Each shared start is emitted once.
    starts = {tuple(said[: i + 1]) for said in want.values() for i in range(len(said))}
    nodes, paths = nodes.collect(), paths.collect()
    assert len(nodes) == len(starts)
    # Trees are gapless, and a node attends to its ancestors, no more.
    spans = {(n.tree, n.offset): n for n in nodes}
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n.tree, []).append((n.offset, n.length))
        assert len(n.tokens) == n.length
    for own in by_tree.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    lines = {}
    for p in sorted(paths, key=lambda p: p.turn_index):
        lines.setdefault(p.conv_id, []).append(spans[(p.tree, p.offset)])
    for line in lines.values():
        before, position = set(), 0
        for n in line:
            assert {x for a in n.attends for x in range(a.begin, a.end)} == before
            assert n.position == position == len(before)
            before |= set(range(n.offset, n.offset + n.length))
            position += n.length
    # Depth first: a node's parent is the last node before it that is its ancestor or a subtree of its siblings.
    parent = {}
    for line in lines.values():
        for a, b in zip([None, *line], line):
            parent[(b.tree, b.offset)] = None if a is None else (a.tree, a.offset)
    for tree, own in by_tree.items():
        stack = []
        for offset, _ in sorted(own):
            up = parent[(tree, offset)]
            while stack and stack[-1] != up:
                stack.pop()
            assert up is None or stack
            stack.append((tree, offset))


def test_chat_escapes(spark, chats):
    nodes, _ = format_conversations(spark.createDataFrame(chats, CHAT), PATH)
    for r in read_nodes(nodes, PATH).collect():
        inner = r.formatted.removeprefix(START).removesuffix(END + "\n")
        assert START not in inner and END not in inner
    empty, none = format_conversations(spark.createDataFrame([], CHAT), PATH)
    assert read_back(empty, none, PATH).count() == 0
