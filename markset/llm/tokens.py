"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once per worker."""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Distinct cuts a worker remembers; later new ones are encoded where they occur.
REMEMBERED = 700_000
#: Characters of text handled, and new cuts given to the library, at a time.
STEP_CHARS, AT_ONCE = 1_000_000, 2_000
#: Cuts that make one text for the library; longer texts take it more time for each cut.
LINED = 200


class TokenIds:
    """Encodes texts as ``encode(text, add_special_tokens=False)`` does.

    Byte-level pre-tokenizers start a new piece at every single space between two words, so a
    text can be cut there and each distinct cut encoded by the library once. Where a space stands
    beside other white space, or a special string occurs, or the tokenizer's settings are others,
    the library gets the whole text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.cuts = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                     and not said.get("normalizer") and not said.get("truncation") and not said.get("padding"))
        special = [re.escape(t["content"]) for t in said.get("added_tokens", [])]
        # a cut is doubtful where white space precedes a space that white space or the end follows
        self.doubtful = re.compile("|".join([r"\s (?:\s|\Z)", *special]))
        self.white = re.compile(r"\s")
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.cuts and len(line) == 1 else None
        self.known: dict[str, int] = {}
        self.n, self.flat = 0, np.zeros(1 << 16, np.uint32)
        self.at, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: list[str]) -> dict[str, int]:
        """Append the ids of distinct new cuts to the pool. A text's first cut has a key of a space and
        itself, any other cut, which a space precedes, is its own key."""
        got, lens = [], []
        for some in itertools.batched(keys, AT_ONCE):  # the library's results are large until their ids are taken
            ids, n = self._ids_of(some)
            got.append(ids)
            lens.append(n)
        ids, lens = np.concatenate(got), np.concatenate(lens)
        start, number = self.n, len(self.lens)
        self.n += int(lens.sum())
        while self.n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[start:self.n] = ids
        self.at = np.concatenate([self.at, start + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        return dict(zip(keys, range(number, number + len(keys)), strict=True))

    def _ids_of(self, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some cuts one after another, and how many each has.

        Cuts that a space precedes and no other white space is in are one text of lines to the library: between a
        word and a space a line feed is a token of its own, so it parts the ids. Others are texts of their own.
        """
        lined = [k[:1] != " " and not self.white.search(k) for k in keys] if self.line is not None else [False] * len(keys)
        lens = np.zeros(len(keys), np.int64)
        parts: list = [None] * len(keys)
        joined = [i for i, x in enumerate(lined) if x]
        if joined:
            lines = ["\n".join([" " + keys[i] for i in some]) for some in itertools.batched(joined, LINED)]
            found = self.library.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(itertools.chain(found[0].ids, *([self.line, *e.ids] for e in found[1:])), np.uint32)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) == len(joined):
                starts = np.append(0, ends[:-1] + 1)
                if len(joined) == len(keys):
                    return ids[ids != self.line], ends - starts
                for i, a, z in zip(joined, starts.tolist(), ends.tolist(), strict=True):
                    parts[i] = ids[a:z]
        rest = [i for i, x in enumerate(parts) if x is None]
        for i, e in zip(rest, self.library.encode_batch_fast([k[1:] if k[:1] == " " else " " + k for k in (keys[i] for i in rest)], add_special_tokens=False), strict=True):
            parts[i] = np.asarray(e.ids, np.uint32)
        lens[:] = [len(x) for x in parts]
        return np.concatenate(parts), lens

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn, a bounded number of characters at a time."""
        step, chars = [], 0
        for t in texts:
            step.append(t)
            chars += len(t)
            if chars > STEP_CHARS:
                yield from self._encode(step)
                step, chars = [], 0
        if step:
            yield from self._encode(step)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not self.cuts or self.doubtful.search(t) is not None for t in texts]
        words: list[str] = []
        ends = []
        for t, w in zip(texts, whole, strict=True):
            if not w:
                first = len(words)
                words += t.split(" ")
                words[first] = " " + words[first]
                ends.append(len(words))
        kept = len(self.lens), self.n
        index = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            fresh = self._learn(list({words[i] for i in missing}))
            if len(self.known) < REMEMBERED:
                self.known |= fresh
                kept = len(self.lens), self.n
            index[missing] = [fresh[words[i]] for i in missing]
        lens = self.lens[index]
        total = np.concatenate([[0], np.cumsum(lens)])
        where = np.repeat(self.at[index] - total[:-1], lens) + np.arange(total[-1])
        ids = self.flat[where]
        self.lens, self.at, self.n = self.lens[:kept[0]], self.at[:kept[0]], kept[1]
        out, k, begin = [], 0, 0
        for t, w in zip(texts, whole, strict=True):
            if w:
                out.append(np.asarray(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                end = total[ends[k]]
                out.append(ids[begin:end])
                begin, k = end, k + 1
        return out


_MADE: dict[str, TokenIds] = {}


def encoder(path: str) -> TokenIds:
    """The worker's encoder for this file; it lives as long as the worker does."""
    if path not in _MADE:
        _MADE[path] = TokenIds(path)
    return _MADE[path]


def some_texts(column: pa.Array, at_once: int = 512) -> Iterator[list[str]]:
    """The texts of a column, null as empty, not all of a batch at a time."""
    for i in range(0, len(column), at_once):
        yield [t or "" for t in column.slice(i, at_once).to_pylist()]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
