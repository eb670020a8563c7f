"""Token ids of whole texts by the ``tokenizers`` library, without encoding the same word twice.

A byte-level BPE never merges across the boundary between a character that is not white space and white
space that follows it. Texts are cut there, each distinct cut is encoded once per worker by the tokenizer,
and the ids are put together again by array lookups. Other tokenizers, and texts that hold one of the
tokenizer's added tokens, are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from tillgrid.llm.textblocks import _WHITE, Block, Lookup, run_hashes

_STORE_LIMIT = 1 << 22
_AT_ONCE = 4_096
_encoders: dict[str, "BlockEncoder"] = {}


def encoder(path: str) -> "BlockEncoder":
    """The encoder of this Python worker, which keeps the words of its earlier tasks."""
    if path not in _encoders:
        _encoders[path] = BlockEncoder(path)
    return _encoders[path]


class BlockEncoder:
    """Encodes blocks of texts; keeps at most about ``_STORE_LIMIT`` ids of words between them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self._by_word = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not said.get("normalizer")
        )
        self._added = [t["content"].encode() for t in said.get("added_tokens", [])]
        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()

    def _clear(self) -> None:
        self._known = Lookup(20)
        self._starts = np.zeros(1, np.int64)
        self._counts = np.zeros(1, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Entries of new words. They are encoded a few thousand at a time: the library's results are large."""
        all_ids, all_counts = [self._ids], []
        for i in range(0, len(words), _AT_ONCE):
            ids = self._encode(words[i : i + _AT_ONCE])
            all_counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            all_ids.append(np.fromiter(chain.from_iterable(ids), np.uint32, all_counts[-1].sum()))
        counts = np.concatenate(all_counts)
        first = len(self._starts)
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(counts) - counts])
        self._counts = np.concatenate([self._counts, counts])
        self._ids = np.concatenate(all_ids)
        return np.arange(first, first + len(words))

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, and where each text's begin (rows + 1 entries)."""
        raw = None
        if not self._by_word or any(block.data.tobytes().find(t) >= 0 for t in self._added):
            raw = [bytes(block.data[a:b]).decode() for a, b in zip(block.offsets, block.offsets[1:])]
            found = self._encode(raw)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((x for one in found for x in one), np.uint32, counts.sum())
            return ids, np.concatenate(([0], np.cumsum(counts)))
        if len(self._ids) > _STORE_LIMIT:
            self._clear()
        starts = self._cuts(block)
        ends = np.append(starts[1:], len(block.data))
        keys = run_hashes(block.data, starts, ends)
        entries = self._known.get(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            distinct, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[first]
            words = [bytes(block.data[a:b]).decode() for a, b in zip(starts[at], ends[at])]
            learned = self._learn(words)
            self._known.add(distinct, learned)
            entries[new] = learned[back]
        counts = self._counts[entries]
        after = np.cumsum(counts)
        ids = self._ids[np.repeat(self._starts[entries] - (after - counts), counts) + np.arange(counts.sum())]
        return ids, np.concatenate(([0], after))[np.searchsorted(starts, block.offsets)]

    @staticmethod
    def _cuts(block: Block) -> np.ndarray:
        """Starts of the cuts: text starts, and white space after a character that surely is none.

        After a character outside ASCII only the two-byte ones from U+00C0 on are safe: all wider white
        space is below or encoded in three bytes.
        """
        data = block.data
        white = _WHITE[data]
        lead = np.zeros(len(data), bool)
        lead[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        safe = np.where(data < 0x80, ~white & (data > 0x20), lead)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = white[1:] & safe[:-1]
        cut[block.offsets[:-1]] = True
        return np.flatnonzero(cut[:-1])
