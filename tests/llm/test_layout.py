"""Packing, sharding and mixing against brute force, with odd rows."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillgrid.llm.mixing import exact_parts, mix, parts_of, places, schedule, slot_table, tempered
from tillgrid.llm.packing import best_fit_decreasing, pack
from tillgrid.llm.sharding import clockwise, plan_loads, ring, shard_rows
from tillgrid.llm.textblocks import text_blocks
from tillgrid.llm.tokens import BlockEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, TOKENIZER = BlockEncoder(PATH), Tokenizer.from_file(PATH)
ODD = ["", None, " ", "a", "don't  stop\n\n now", "x  y", "é è  z", "12 345,6", "a <|endoftext|> b", "\t\tx ", "日本 語 文", "end\n"]


@given(st.lists(st.text(alphabet="aB1é   \n\t'.,日s<|>", max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_agrees_with_the_tokenizer(texts):
    encoder, plain = ENCODER, TOKENIZER
    for rows in (texts, [*ODD, *texts], ["", *texts, ""]):
        for block in text_blocks(pa.array(rows, pa.string())):
            ids, bounds = encoder.ids(block)
            for i in range(block.rows):
                want = plain.encode(rows[block.first + i] or "", add_special_tokens=False).ids
                assert ids[bounds[i] : bounds[i + 1]].tolist() == want


@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing(lengths):
    windows, offsets = best_fit_decreasing(np.array(lengths, np.int64), 20)
    room = []
    where = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w, r in enumerate(room) if r >= lengths[i]]
        tight = min((room[w] for w in fits), default=None)
        assert (windows[i] >= len(room)) == (tight is None)
        if tight is None:
            room.append(20)
        assert room[windows[i]] == (20 if tight is None else tight)
        where[i] = 20 - room[windows[i]]
        room[windows[i]] -= lengths[i]
    assert [where[i] for i in range(len(lengths))] == offsets.tolist()


def test_pack(make):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000))
    rows = [(i, t) for i, t in enumerate([*ODD, long, long, *("word " * int(n) for n in rng.integers(1, 1500, 40))])]
    rows += [(3, "again"), (3, "again"), (None, "nobody")]
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            part = np.array(ids[a : a + 2048], "<u4")
            want[(i, a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    for group_pieces in (10_000, 20):
        got = pack(make(rows), PATH, group_pieces=group_pieces).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for spans in by.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 2048
        if group_pieces == 10_000:
            assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert pack(make([]), PATH).count() == 0


def test_shards(make):
    rng = np.random.default_rng(4)
    texts = ["same " * 9] * 30 + ["", None, "é"] + [" ".join(["w"] * int(n)) for n in rng.integers(1, 300, 60)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)] + [(5, "dup"), (5, "dup")] + [(None, "x")] * 20
    got = shard_rows(make(rows), shards=7, cells=512).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(tuple(r)[:3] for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    again = shard_rows(make(rows[::-1]), shards=7, cells=512).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(tuple(r)[:4] for r in again)
    assert shard_rows(make([])).count() == 0
    few = shard_rows(make(rows[:3])).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_loads_go_clockwise_and_little_moves():
    rng = np.random.default_rng(1)
    points, more = ring(16), ring(17)
    assert set(points) <= set(more) or len(set(points) - set(more)) < 3
    counts = rng.integers(0, 40, len(points)).tolist()
    n = sum(counts)
    plan = plan_loads(counts, points, [n // 16 + (s < n % 16) for s in range(16)])
    assert sum(hi - lo for _, _, lo, hi, _ in plan) == n
    for arc, shard, lo, hi, _ in plan:
        earlier = [s for a, s, x, y, _ in plan if a == arc and y <= lo]
        walk = clockwise(points, arc)
        assert all(walk.index(s) < walk.index(shard) for s in earlier)
    owner = {place: shard for place, shard in points}
    moved = sum(shard == 16 for _, shard in more if _ not in owner)
    assert moved >= 60  # the new shard's own nodes; no old node changed hands
    assert all(dict(more)[p] == s for p, s in points)


@given(st.dictionaries(st.sampled_from("abcdefg"), st.floats(0.01, 50), min_size=1))
@settings(max_examples=60, deadline=None)
def test_schedule_stays_within_one_block(weights):
    parts = parts_of(weights, 100)
    assert sum(parts.values()) == 100
    slots = schedule(parts)
    at = sorted((t, s) for s, ts in slots.items() for t in ts)
    assert [t for t, _ in at] == list(range(100))
    done = Counter()
    for t, s in at:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * a / 100) < 1 for x, a in parts.items())


@pytest.mark.parametrize("power, weights", [(0.5, None), (1.0, {"big": 1.0, "mid": 2.0, "tiny": 1.0, None: 0.5, "absent": 3.0})])
def test_mix(make, power, weights):
    rows = [(i, "t", None, s, 1) for i, s in enumerate(["big"] * 90 + ["mid"] * 31 + ["tiny"] * 2 + [None] * 5)]
    rows += [(0, "t", None, "big", 1), (None, "t", None, "mid", 1)]
    df = make(rows)
    got = mix(df, weights=weights, power=power, block_rows=4, period=50, cell_rows=10)
    assert got.columns == [*df.columns, "mix_epoch", "mix_block", "mix_slot_", "mix_place"]
    got = got.collect()
    assert {(r.doc_id, r.source) for r in got} == {(i, s) for i, _, _, s, _ in rows}
    sizes = Counter(s for *_, s, _ in rows)
    shares = weights or {s: n**power for s, n in sizes.items()}
    parts = parts_of({str(s): shares[s] for s in sizes}, 50)
    slots = {}
    for r in got:
        slots.setdefault(r["mix_slot_"], []).append(r)
    assert sorted(slots) == list(range(len(slots)))
    done = Counter()
    for t in range(len(slots)):
        (source,) = {r.source for r in slots[t]}
        assert {r.mix_block for r in slots[t]} == {done[source]}
        assert sorted(r.mix_place for r in slots[t]) == list(range(4))
        done[source] += 1
        # Less than a block from the weights, in rows.
        assert all(abs(4 * done[s] - 4 * (t + 1) * parts[str(s)] / 50) < 4 for s in sizes)
    for s in sizes:  # the endless sequence of a source
        order = [r for t in range(len(slots)) for r in sorted(slots[t], key=lambda r: r.mix_place) if r.source == s]
        assert [r.mix_epoch for r in order] == [i // sizes[s] for i in range(len(order))]
        assert [r.doc_id for r in order[sizes[s] :]] == [r.doc_id for r in order[: -sizes[s]]]
    whole = Counter((r.doc_id, r.source) for r in got if r.mix_epoch == 0)
    assert whole == Counter((i, s) for i, _, _, s, _ in rows)


def test_mix_of_nothing_and_missing_weight(make):
    assert mix(make([])).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        mix(make([(1, "t", None, "x", 1)]), weights={"y": 1.0})


def test_unrounded_weights_over_many_slots():
    """Less than one block from the given weights at every slot, also for sources far below one part in 1,000."""
    sizes = {"big": 100_000, "mid": 7_777, **{f"one{i}": 1 for i in range(40)}}
    shares = tempered(sizes, 0.8)
    total = sum(Fraction(w) for w in shares.values())
    assert min(shares.values()) / total < 1 / 5_000
    done = Counter()
    for s, block, epoch, slot in places(exact_parts(shares), {s: -(-n // 32) for s, n in sizes.items()}):
        assert divmod(done[s], -(-sizes[s] // 32)) == (epoch, block)
        done[s] += 1
        for x in (s, "big", "mid", "one0", "one39"):
            assert abs(done[x] - (slot + 1) * Fraction(shares[x]) / total) < 1
    assert slot > 5_000 and max(done[f"one{i}"] for i in range(40)) <= 2


def test_mix_keeps_the_given_weights(make):
    rows = [(i, "t", None, "big" if i < 3_000 else f"one{i}", 1) for i in range(3_004)]
    weights = {"big": 1.0, **{f"one{i}": 0.0004 for i in range(3_000, 3_004)}}
    got = mix(make(rows), weights=weights, block_rows=1, cell_rows=100).collect()
    total = 1.0 + 4 * 0.0004
    order = sorted((r["mix_slot_"], r.source) for r in got)
    assert [t for t, _ in order] == list(range(len(got)))
    done = Counter()
    for t, s in order:
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * w / total) < 1 + 1e-9 for x, w in weights.items())
    assert {r.doc_id for r in got} == {r[0] for r in rows} and max(done[f"one{i}"] for i in range(3_000, 3_004)) <= 2


def test_slots_come_in_ranges(spark):
    parts, blocks = {"a": 3, "b": 2}, {"a": 7, "b": 1}
    want = list(places(parts, blocks))
    for slots in (1, 4, 1_000):
        got = slot_table(spark, parts, blocks, slots).collect()
        assert sorted(map(tuple, got), key=lambda r: r[3]) == want


def test_mix_of_many_sources(make):
    """More sources than the 1,000 slots of a former period."""
    rows = [(i, "t", None, f"site{i % 1_001}", 1) for i in range(1_201)]
    got = mix(make(rows)).collect()
    assert {(r.doc_id, r.source) for r in got} == {(r[0], r[3]) for r in rows}
    assert {r["mix_slot_"] for r in got} == set(range(len({r["mix_slot_"] for r in got})))
    whole = Counter(r.doc_id for r in got if r.mix_epoch == 0)
    assert whole == Counter(range(1_201))


def test_mix_holds_weights_in_rows(make):
    """Sources below a block, of 3,200, 33 and 1 rows."""
    rows = [(i, "t", None, "a" if i < 3_200 else "b" if i < 3_233 else "c", 1) for i in range(3_234)]
    got = mix(make(rows), weights={"a": 0.5, "b": 0.3, "c": 0.2}).collect()
    counts = Counter(r.source for r in got)
    assert all(abs(counts[s] - w * len(got)) < 32 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert {r.doc_id for r in got} == set(range(3_234))

def test_shards_split_a_place_with_many_rows(make):
    """Rows without an id, with one id, and with one text, in places that are ranked in parts."""
    rows = [(None, f"t{i % 40}") for i in range(300)] + [(5, "same") for _ in range(200)] + [(i, "x") for i in range(100, 160)]
    got = shard_rows(make(rows).repartition(6), shards=7, cells=512, part_rows=16).collect()
    assert len(got) == len(rows)
    assert Counter(r.id for r in got) == Counter(i for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(len, slots.values())) == [80] * 7


def test_mix_deals_rows_without_an_id_by_their_content(make):
    rows = [(None, f"t{i}", "en", "a", 1) for i in range(500)] + [(None, "t", "en", "a", 1)] * 3 + [(i, "u", "en", "b", 1) for i in range(40)]
    got = mix(make(rows), weights={"a": 1.0, "b": 0.1}, cell_rows=20)
    first = got.where("mix_epoch = 0").collect()
    assert Counter((r.doc_id, r.text) for r in first) == Counter((i, t) for i, t, *_ in rows)
    places = [(r["mix_slot_"], r.mix_place) for r in got.collect()]
    assert len(set(places)) == len(places)
