"""The pipeline against a plain version of its stages, and every query of the subpackage."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from tokenizers import Tokenizer

import corpus_pipeline
from tillgrid.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert differences(df, connect(SF_DIR), SQL[name]) == []
    else:
        assert df.count() > 0


def test_stages(spark, make):
    """Each stage does to a small table what is said of it."""
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("ra", "se", "ti", "vu", "zo")]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    near = texts[0].split()
    near[-1] = "other"
    texts += [texts[1], texts[2].replace(" ", "  "), " ".join(near), None, "", "123 456"]
    rows = [(i, t, "en", "s1" if i < 25 else "s2", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s1", 1)]
    docs = make(rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == make(rows).columns
    ids = {name: Counter(r.doc_id for r in kept) for name, kept in seen.items()}
    assert ids["language_id"] == Counter([*range(33), 3])
    assert ids["exact_dedup"] == Counter(i for i in range(33) if i not in (30, 31))
    assert ids["near_dedup"] == Counter(range(30))
    assert set(ids["mixing"]) == set(range(30))
    rows_of = Counter(r.source for r in seen["mixing"])
    share = 25**0.8 / (25**0.8 + 5**0.8)
    assert abs(rows_of["s1"] - share * rows_of.total()) < 32  # less than a block from the weights
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in seen["mixing"]:
        ids_ = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want[(r.doc_id, 0, len(ids_), zlib.crc32(ids_.tobytes()), len(ids_))] += 1
    assert Counter(tuple(r)[:5] for r in seen["packing"]) == want


def test_stages_of_nothing(spark, make):
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_stages_without_labels(spark, make):
    docs = corpus_pipeline.identify_language(spark, make([(1, "abc", None, "s", 1), (2, "1", None, "s", 1)]), "")
    assert [r.doc_id for r in docs.collect()] == [1]


def test_names():
    numbers = sorted(int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
