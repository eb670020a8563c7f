"""Scoring by a Brown class model: P(word | previous word) = P(class | previous class) P(word | class).

Counts of all words of all training rows come from one grouping. The most frequent words are given to the
classes by exchange on the driver: each word in turn moves to the class that raises the likelihood of
the corpus most, judged by the counts of all neighbouring words in all training rows. Then every other word
with at least ``HEAD_COUNT`` tokens moves in Spark to the class of most gain, all words of a round at once,
judged by its counts next to each class in all training rows; in the first round words without a class stand
for the magnitude of their count, in later ones for the class they got. A round that lowers the likelihood of the
training rows is undone and is the last. How many words the driver exchanges
and how many classes there are grows with the vocabulary. Rarer and unseen words form one more class.
Transitions are smoothed towards the classes' own frequency. In the rare class an
absolute discount, estimated from the words met once and twice, leaves room for unseen words, which share it
evenly among as many types as those words let expect (``novel``); so the probabilities of all types sum to
one and every text has one.

What is sent to all tasks are ``head`` words with their classes and the square of the number of classes. The
classes and counts of all other words meet the training pairs and the texts in joins, as neighbours too, so the
result is the same for every ``head`` that holds the words the driver exchanges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.support import col, settle
from tillgrid.llm.textblocks import Lookup, rows_of, run_hashes, text_blocks

HEAD = 1 << 20  # some 50 MB for a task; words beyond cost joins, and give the same result
CLASS_WORDS = 1_024  # at least, see ``grown``
CLASSES = 48  # at least
ROUNDS = 6
SPREADS = 2  # rounds over the words that the driver does not exchange
END = -1  # the key of the end token; no word's fingerprint but by a chance of 2**-64
BASE_ADD = 0.1
PULL = 5.0
HEAD_COUNT = 4  # rarer words are in the rare class
_CELLS = 1 << 19
_DENSE = 1 << 23  # cells that a task adds up in place
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grown(words: int) -> tuple[int, int]:
    """How many words the driver exchanges, and among how many classes, for a vocabulary of ``words``."""
    classes = max(CLASSES, round(words ** (1 / 3)))
    return max(CLASS_WORDS, 8 * classes), classes


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def unseen_types(once: int, twice: int) -> float:
    """How many types of words were never met, at least, from how many were met once and twice (Chao's estimate)."""
    return max(1.0, once * (once - 1) / (2 * (twice + 1)))


def novel(once: int, twice: int, rare_words: int) -> tuple[float, float]:
    """The discount from each rare word's count, and among how many unseen types the sum is shared.

    They are at least so many that none of them is likelier than a word met once.
    """
    discount = once / (once + 2 * twice) if once and twice else 0.5
    return discount, max(unseen_types(once, twice), discount * rare_words / (1 - discount))


def likelihood(grid: np.ndarray) -> float:
    """The part of the log likelihood of the training rows that depends on the classes."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum() - _xlogx(grid.sum(axis=1)).sum())


def exchange(pairs: np.ndarray, movable: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit, for counts of neighbouring units.

    The first ``movable`` units share ``classes`` classes; every other unit has one of its own.
    """
    units = len(pairs)
    fixed = units - movable
    of = np.concatenate((np.arange(movable) % max(1, classes), classes + np.arange(fixed)))
    total = classes + fixed
    member = np.zeros((units, total))
    member[np.arange(units), of] = 1
    right, left = pairs @ member, pairs.T @ member  # counts of a unit before, and after, each class
    grid = member.T @ right
    before, after = pairs.sum(axis=1), pairs.sum(axis=0)
    first, second = member.T @ before, member.T @ after
    at = np.arange(classes)
    for _ in range(rounds if classes > 1 else 0):
        moved = 0
        for w in range(movable):
            old, r, l, self_ = of[w], right[w], left[w], pairs[w, w]
            # Take the word out.
            grid[old] -= r
            grid[:, old] -= l
            grid[old, old] += self_
            first[old] -= before[w]
            second[old] -= after[w]
            r, l = r.copy(), l.copy()
            r[old] -= self_
            l[old] -= self_
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (_xlogx(rows + r) - _xlogx(rows)).sum(axis=1) + (_xlogx(cols + l) - _xlogx(cols)).sum(axis=1)
            own = grid[at, at]
            gain += _xlogx(own + r[at] + l[at] + self_) + _xlogx(own) - _xlogx(own + r[at]) - _xlogx(own + l[at])
            gain -= _xlogx(first[:classes] + before[w]) - _xlogx(first[:classes])
            gain -= _xlogx(second[:classes] + after[w]) - _xlogx(second[:classes])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new] += r
            grid[:, new] += l
            grid[new, new] += self_
            first[new] += before[w]
            second[new] += after[w]
            if new != old:
                moved += 1
                of[w] = new
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if not moved:
            break
    return of


def best_classes(
    grid: np.ndarray, classes: int, of: np.ndarray, starts: np.ndarray, context: np.ndarray, n: np.ndarray
) -> np.ndarray:
    """The class of most gain in likelihood for each word, all judged by the same grid.

    The word's counts begin at ``starts``; a context is twice a class, and one more where that class comes
    before the word. ``of`` is the class that the word's counts are part of in the grid, or -1.
    """
    words, side, other = np.repeat(np.arange(len(of)), np.diff(np.append(starts, len(n)))), context & 1, context >> 1
    n, inside, at = n.astype(float), np.flatnonzero(of >= 0), np.arange(classes)
    now = np.stack((grid[:classes].T, grid[:, :classes]))[side, other]
    own = np.flatnonzero(of[words] >= 0)
    now[own, of[words[own]]] -= n[own]
    now = np.maximum(now, 0)
    gain = np.add.reduceat(_xlogx(now + n[:, None]) - _xlogx(now), starts)
    met = np.zeros((2, len(of), classes))
    near = other < classes
    met[side[near], words[near], other[near]] = n[near]
    twice = np.tile(grid[at, at], (len(of), 1))
    twice[inside, of[inside]] -= met[:, inside, of[inside]].sum(axis=0)
    twice = np.maximum(twice, 0)
    gain += _xlogx(twice + met.sum(axis=0)) + _xlogx(twice) - _xlogx(twice + met[0]) - _xlogx(twice + met[1])
    for k in (0, 1):
        ahead = np.tile(grid.sum(axis=1 - k)[:classes], (len(of), 1))
        weight = np.bincount(words, np.where(side == k, n, 0), len(of))
        ahead[inside, of[inside]] -= weight[inside]
        ahead = np.maximum(ahead, 0)
        gain -= _xlogx(ahead + weight[:, None]) - _xlogx(ahead)
    best = gain.argmax(axis=1)
    stay = inside[gain[inside, best[inside]] <= gain[inside, of[inside]] + 1e-9]
    best[stay] = of[stay]
    return best


def score_texts(
    df: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = HEAD,
    class_words: int | None = None,
    classes: int | None = None,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Learns from the rows that are not held out. Words are lower-cased (A to Z), and each text ends with an
    end token. ``n_known`` counts tokens seen in training; ``base_score`` is the unigram score with 0.1 added
    to each count; ``score`` is the model's; both are base-10 logarithms of the whole text's probability.
    ``score / -n_tokens`` to the power of ten is the perplexity. A null or empty text is an end token. Rows
    that repeat an id or have none are scored each. Without training rows every word is unseen. An empty
    table gives no rows; other columns are ignored. ``class_words`` and ``classes`` follow the vocabulary
    (``grown``) where they are not given.
    """
    docs = df.select(
        col(id_col).cast("long").alias("doc"), held_out.alias("held_out"), col(text_col).cast("string").alias("text")
    )
    train = docs.where(~F.col("held_out")).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                starts, ends, _ = block.words()
                keys, n = np.unique(run_hashes(block.data, starts, ends, lower=True).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(keys, END)), pa.array(np.append(n, block.rows))], names=["key", "n"]
                )

    vocabulary = settle(train.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    words = vocabulary.where(F.col("key") != END)
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    once, twice = words.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = words.where(F.col("n") >= HEAD_COUNT).orderBy(F.desc("n"), "key").limit(head).toArrow()  # ``head`` rows at most
    head_keys = top.column("key").to_numpy().view(np.uint64)
    head_counts = top.column("n").to_numpy().astype(np.int64)
    ends = int(vocabulary.where(F.col("key") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common = words.where(F.col("n") >= HEAD_COUNT)
    common_words, common_tokens = common.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    class_words, classes = (given or own for given, own in zip((class_words, classes), grown(common_words)))
    movable = min(class_words, len(head_keys))
    least = HEAD_COUNT.bit_length() - 1
    bands = int(head_counts[movable - 1]).bit_length() - least if common_words > movable else 0
    end_unit, rare_unit = movable + bands, movable + bands + 1
    units = rare_unit + 1
    band = np.frexp(head_counts[movable:])[1] - 1 - least  # a band for each power of two
    unit_of = np.concatenate((np.arange(movable), movable + band, [rare_unit]))  # the last is for index -1
    beyond = common_words > len(head_keys)  # else every word outside the head is in the rare class

    def sequences(block, known: Lookup):
        """Fingerprints, their head index (-1: none), bounds of words and of tokens."""
        starts, stops, bounds = block.words()
        keys = run_hashes(block.data, starts, stops, lower=True)
        return keys, known.get(keys), bounds, bounds + np.arange(block.rows + 1)

    def known_words() -> Lookup:
        known = Lookup(max(12, len(head_keys).bit_length() + 1))
        known.add(head_keys, np.arange(len(head_keys)))
        return known

    def neighbours(kind_of: np.ndarray, end: int, total: int, outside: DataFrame | None) -> np.ndarray:
        """Counts of a kind (unit or class) before a kind over all training rows.

        ``kind_of`` is by head index, the last for words that are neither there nor in ``outside`` (``key``, ``class``).
        """
        spare, closed = int(kind_of[-1]), outside is None

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs of kinds (0), of a word outside the head before (1) or after (2) a kind, and of two such words (3)."""
            known, seen = known_words(), np.zeros(total * total, np.int64)

            def rows(case, a, b, n):
                columns = [pa.array(np.full(len(n), case), pa.int64()), *(pa.array(x.astype(np.int64)) for x in (a, b, n))]
                return pa.RecordBatch.from_arrays(columns, names=["case", "a", "b", "n"])

            for batch in batches:
                for block in text_blocks(batch.column("text")):
                    keys, index, bounds, _ = sequences(block, known)
                    kind = kind_of[index] if closed else np.where(index < 0, -1, kind_of[index])
                    line = np.insert(kind, bounds[1:], end)
                    last = np.concatenate(([end], line[:-1]))
                    case = (last < 0) + 2 * (line < 0)
                    both = case == 0
                    np.add.at(seen, last[both] * total + line[both], 1)
                    if both.all():
                        continue
                    names = np.insert(keys.view(np.int64), bounds[1:], END)
                    named = np.concatenate(([END], names[:-1]))
                    for k, a, b in ((1, named, line), (2, names, last), (3, named, names)):
                        a, b = a[case == k], b[case == k]
                        yield rows(k, a, b, np.ones(len(a)))
            at = np.flatnonzero(seen)
            yield rows(0, at // total, at % total, seen[at])

        met = train.mapInArrow(count, "case long, a long, b long, n long").groupBy("case", "a", "b").agg(F.sum("n").alias("n"))
        if closed:
            table = met
        else:
            met = settle(met)

            def classed(df: DataFrame, name: str) -> DataFrame:
                """The fingerprint in this column gives way to its kind."""
                of = outside.select(F.col("key").alias(name), "class")
                kept = [c for c in df.columns if c != name]
                return df.join(of, name, "left").select(*kept, F.coalesce("class", F.lit(spare)).cast("long").alias(name))

            one = classed(met.where(F.col("case").isin(1, 2)), "a")
            one = one.select(*(F.when(F.col("case") == 1, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"))), "n")
            two = classed(classed(met.where(F.col("case") == 3), "a"), "b").select("a", "b", "n")
            table = met.where(F.col("case") == 0).select("a", "b", "n").unionByName(one).unionByName(two)
            table = table.groupBy("a", "b").agg(F.sum("n").alias("n"))
        table = table.select("a", "b", "n").toArrow()  # at most the square of the number of kinds
        grid = np.zeros((total, total))
        grid[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("n").to_numpy()
        return grid

    outside = None
    if beyond:
        last_key, last_count = int(head_keys.view(np.int64)[-1]), int(head_counts[-1])
        after = (F.col("n") < last_count) | ((F.col("n") == last_count) & (F.col("key") > last_key))
        unit = F.length(F.bin("n")) - 1 - least + movable
        outside = common.where(after).select("key", unit.cast("long").alias("class"))
    pairs = neighbours(unit_of, end_unit, units, outside)
    classes = min(classes, max(1, movable))
    class_of = exchange(pairs, movable, classes)
    total = int(class_of.max()) + 1
    grid = np.zeros((total, total))
    np.add.at(grid, (class_of[:, None], class_of[None, :]), pairs)
    kind_of, end = class_of[unit_of], int(class_of[end_unit])  # by head index; the last is for index -1
    # Every unit behind the exchanged ones has a class of its own, in the same order.
    if outside is not None:
        outside = outside.select("key", (F.col("class") - movable + classes).alias("class"))

    def counted(key, context, other, n) -> pa.RecordBatch:
        columns = [pa.array(np.asarray(x, np.int64)) for x in (key, context, other, n)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "context", "other", "n"])

    def contexts(kind_of: np.ndarray, end: int, total: int, outside: DataFrame | None):
        closed = outside is None

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts of a word next to a class, and, with an ``other`` (else ``END``), next to a word outside the head.

            Frequent words are counted in a table of bounded size, once for the task.
            """
            known = known_words()
            dense = min(len(head_keys), max(movable, _DENSE // (2 * total)))
            held = np.zeros((dense - movable) * 2 * total, np.int32)
            for batch in batches:
                for block in text_blocks(batch.column("text")):
                    keys, index, bounds, _ = sequences(block, known)
                    kind = kind_of[index] if closed else np.where(index < 0, -1, kind_of[index])
                    line = np.insert(kind, bounds[1:], end)
                    last = np.concatenate(([end], line[:-1]))
                    # Where the head holds all common words, all others are rare and keep their class.
                    free = np.flatnonzero(index >= movable if closed else (index < 0) | (index >= movable))
                    at = free + rows_of(bounds)[free]
                    if not closed:
                        names = np.insert(keys.view(np.int64), bounds[1:], END)
                        open_ = [(0, at[line[at + 1] < 0], 1), (1, at[last[at] < 0], -1)]
                        for side, here, step_ in open_:
                            yield counted(names[here], np.full(len(here), side), names[here + step_], np.ones(len(here), np.int64))
                    for side, beside in ((0, line[at + 1]), (1, last[at])):
                        often = (index[free] >= 0) & (index[free] < dense) & (beside >= 0)
                        np.add.at(held, (index[free[often]] - movable) * (2 * total) + beside[often] * 2 + side, 1)
                    free = free[(index[free] < 0) | (index[free] >= dense)]
                    at, own = free + rows_of(bounds)[free], keys[free]
                    own, context = np.tile(own, 2), np.concatenate((line[at + 1] * 2, last[at] * 2 + 1))
                    own, context = own[context >= 0], context[context >= 0]
                    _, first, n = np.unique(own + context.astype(np.uint64) * _ODD, return_index=True, return_counts=True)
                    yield counted(own[first].view(np.int64), context[first], np.full(len(first), END), n)
            at = np.flatnonzero(held)
            for i in range(0, len(at), _CELLS):
                some = at[i : i + _CELLS]
                own = head_keys[movable + some // (2 * total)].view(np.int64)
                yield counted(own, some % (2 * total), np.full(len(some), END), held[some].astype(np.int64))

        # Tasks have added up what they can, so rows are dealt by word once; a word has at most two contexts a class.
        rows = train.mapInArrow(count, "key long, context long, other long, n long")
        if closed:
            rows = rows.drop("other")
        else:
            rows = rows.groupBy("key", "context", "other").agg(F.sum("n").alias("n"))
            of = outside.select(F.col("key").alias("other"), "class")
            kind = F.coalesce("class", F.lit(int(kind_of[-1])))
            rows = settle(rows)
            beside = rows.where(F.col("other") != END).join(of, "other", "left").select("key", (kind * 2 + F.col("context")).alias("context"), "n")
            rows = rows.where(F.col("other") == END).select("key", "context", "n").unionByName(beside)
        rows = rows.repartition("key").groupBy("key", "context").agg(F.sum("n").alias("n"))
        rows = rows.groupBy("key").agg(F.collect_list(F.struct("context", "n")).alias("c"))
        return settle(rows.select("key", F.col("c.context").alias("contexts"), F.col("c.n").alias("counts")))

    def moves(grid: np.ndarray):
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = known_words()
            for batch in batches:
                index = known.get(batch.column("key").to_numpy().view(np.uint64))
                of = batch.column("of").to_numpy()
                context, n = (batch.column(c).flatten().to_numpy() for c in ("contexts", "counts"))
                bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("counts")).to_numpy())))
                best, i = np.zeros(len(of), np.int64), 0
                while i < len(of):
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _CELLS // classes, "right")) - 1)
                    inner = slice(bounds[i], bounds[j])
                    best[i:j] = best_classes(grid, classes, of[i:j], bounds[i:j] - bounds[i], context[inner], n[inner])
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(index), batch.column("total"), pa.array(best)], names=["key", "at", "n", "class"]
                )

        return move

    current = common.select("key", F.col("n").alias("total"), F.lit(-1).cast("long").alias("of"))
    others, kept = current.where(F.lit(False)).select("key", F.col("total").alias("n"), F.col("of").alias("class")), None
    for _ in range(SPREADS if common_words > movable else 0):
        lists = contexts(kind_of, end, total, outside).join(current, "key")
        moved = settle(lists.mapInArrow(moves(grid), "key long, at long, n long, class long"))
        got = moved.where(F.col("at") >= 0).select("at", "class").toArrow()  # ``head`` rows at most
        kind_of = kind_of.copy()
        kind_of[got.column("at").to_numpy()] = got.column("class").to_numpy()
        kind_of[-1] = classes + 1
        end, total = classes, classes + 2
        others, outside = moved.where(F.col("at") < 0).select("key", "n", "class"), None
        if beyond:
            outside = others.select("key", "class")
        current = moved.select("key", F.col("n").alias("total"), F.col("class").alias("of"))
        grid = neighbours(kind_of, end, total, outside)
        if kept is not None and likelihood(grid) < likelihood(kept[1]):
            kind_of, grid, others = kept
            break
        kept = kind_of, grid, others
    rare = classes + 1
    if kept is None:  # all words with enough counts are exchanged, and no magnitude is left
        end, total = classes, classes + 2
        kind_of = np.append(kind_of[:-1], rare)
        grid = neighbours(kind_of, end, total, None)
    size = np.zeros(total)
    np.add.at(size, kind_of[:-1], head_counts)
    for k, n in others.groupBy("class").agg(F.sum("n")).collect():  # one row per class
        size[k] += n
    rare_tokens = int(tokens) - ends - int(common_tokens)
    rare_words = max(0, int(distinct) - int(common_words) - (ends > 0))
    size[end], size[rare] = ends, rare_tokens
    alone = (size + 0.5) / (size.sum() + 0.5 * total)
    step = np.log10((grid + PULL * alone) / (grid.sum(axis=1, keepdims=True) + PULL))
    emit = np.log10(head_counts / size[kind_of[:-1]])
    base_under = float(tokens + BASE_ADD * (distinct + 1))
    base = np.log10((head_counts + BASE_ADD) / base_under)
    base_end = float(np.log10((ends + BASE_ADD) / base_under))
    discount, strange = novel(once, twice, rare_words)
    unseen = float(np.log10(discount * rare_words / rare_tokens / strange)) if rare_tokens else -float(np.log10(strange))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = known_words(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                keys, index, bounds, turns = sequences(block, known)
                row, hit = rows_of(bounds), index >= 0
                kind = np.insert(np.where(hit, kind_of[index], -1), bounds[1:], end)
                last = np.concatenate(([end], kind[:-1]))
                open_ = (last < 0) | (kind < 0)
                sums = np.add.reduceat(np.where(open_, 0, step[last, kind]), turns[:-1])
                sums += np.bincount(row[hit], emit[index[hit]], block.rows)
                plain = np.bincount(row[hit], base[index[hit]], block.rows) + base_end
                found = np.bincount(row[hit], minlength=block.rows) + (ends > 0)
                miss = ~hit
                at, own = row[miss], keys[miss].view(np.int64)
                order = np.lexsort((own, at))
                at, own = at[order], own[order]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(at)))
                firsts = np.searchsorted(at[heads], np.arange(block.rows + 1))
                lists = pa.array(firsts, pa.int32())
                # Words without a class here stand as -1 less their place in the row's list of keys.
                named = np.zeros(len(order), np.int64)
                named[order] = -1 - (np.cumsum(new) - 1 - firsts[at])
                kind[np.flatnonzero(miss) + row[miss]] = named
                last = np.concatenate(([end], kind[:-1]))
                gaps = pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(open_.astype(np.int64), turns[:-1])))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(made, made + block.rows)),
                        batch.column("doc").slice(block.first, block.rows),
                        batch.column("held_out").slice(block.first, block.rows),
                        pa.array(np.diff(turns)),
                        pa.array(found),
                        pa.array(plain),
                        pa.array(sums),
                        pa.ListArray.from_arrays(lists, pa.array(own[heads])),
                        pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())),
                        pa.ListArray.from_arrays(gaps, pa.array(last[open_], pa.int32())),
                        pa.ListArray.from_arrays(gaps, pa.array(kind[open_], pa.int32())),
                    ],
                    names=["at", "doc", "held_out", "n_tokens", "n_known", "base", "score", "keys", "times", "froms", "tos"],
                )
                made += block.rows

    scored = settle(
        docs.mapInArrow(
            score,
            "at long, doc long, held_out boolean, n_tokens long, n_known long, base double, score double, "
            "keys array<long>, times array<long>, froms array<int>, tos array<int>",
        )
    )
    asked = scored.where(F.size("keys") > 0).select("at", F.posexplode(F.arrays_zip("keys", "times")).alias("place", "word"))
    asked = asked.select("at", "place", F.col("word.keys").alias("key"), F.col("word.times").alias("times"))
    known = words.join(others.select("key", "class"), "key", "left")
    seen, sizes = F.coalesce("n", F.lit(0)), F.get(F.lit(size.tolist()), F.col("class").cast("int"))
    sums = (
        asked.join(known, "key", "left")
        .groupBy("at")
        .agg(
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((seen + BASE_ADD) / base_under)).alias("more_base"),
            F.sum(
                F.col("times")
                * F.when(F.col("class").isNotNull(), F.log10(seen / sizes))
                .when(seen > 0, F.log10((seen - discount) / float(max(1, rare_tokens))))
                .otherwise(unseen)
            ).alias("more_score"),
            F.collect_list(F.struct("place", F.coalesce("class", F.lit(rare)).cast("int").alias("class"))).alias("found"),
        )
    )

    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the transitions from and to the words outside the head."""
        for batch in batches:
            rows = batch.num_rows
            length = {c: pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy() for c in ("places", "froms")}
            ahead = np.cumsum(length["places"]) - length["places"]
            kinds = np.zeros(int(length["places"].sum()), np.int64)
            row = np.repeat(np.arange(rows), length["places"])
            kinds[ahead[row] + batch.column("places").flatten().to_numpy()] = batch.column("kinds").flatten().to_numpy()
            row = np.repeat(np.arange(rows), length["froms"])
            pair = [batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("froms", "tos")]
            for x in pair:
                x[x < 0] = kinds[ahead[row[x < 0]] - 1 - x[x < 0]]
            score = batch.column("score").to_numpy() + np.bincount(row, step[pair[0], pair[1]], rows)
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return scored.join(sums, "at", "left").select(
        F.col("doc").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        F.col("found.place").alias("places"), F.col("found.class").alias("kinds"), "froms", "tos",
    ).mapInArrow(
        bridge,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
