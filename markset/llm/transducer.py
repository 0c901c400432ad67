"""Token counts by a compiled finite-state transducer.

A pre-token's byte-pair encoding is followed byte by byte. Removing the last token of an encoding
leaves the encoding of the shorter prefix, so the encoding of a prefix is known from its last token
and the encodings of shorter prefixes. A state holds, for each suffix of the bytes read that may
still grow into a token, where that suffix stands in the trie of tokens, the last token before it and
how many tokens fewer that prefix had. That is finite, and a byte leads to one next state and changes
the count by a fixed number: a deterministic transducer whose transitions carry token counts. States
are compiled when they are first reached and shared by all words.

A text is a run of chunks. A chunk's map says what it does to any state in which the text before left
the automaton that cuts texts into pre-tokens: a piece of text that closes the open pre-token, the
tokens of those that lie within, and what it leaves open. Maps compose associatively, so the chunks of
a text are summed by a balanced scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markset.llm.common import table, tokenizer_path, whole_text
from markset.llm.tokens import some_texts

MOST_TOKENS = 512
CHUNK = 1 << 15
#: Compiled states a worker keeps before it compiles afresh, distinct cuts whose counts it keeps and pairs of tokens that it has looked at, at most.
STATES, COUNTED, PAIRS = 250_000, 600_000, 300_000

#: Fixed value: how byte-level tokenizers cut text into pre-tokens.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: At white space that follows something else a pre-token always begins.
EDGE = re.compile(r"(?<=\S)[\x20\x09-\x0D]")
#: Text in which a cut at every space would not be a cut between pre-tokens.
DOUBTFUL = re.compile(r"\s (?:\s|\Z)")

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are written
    as themselves, the others by the letters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {chr(b) if b in plain else chr(next(others)): b for b in range(256)}


class Transducer:
    """Counts the tokens of pre-tokens. ``ranks`` gives each token's bytes and its rank of merging."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        #: the trie: a node's number and a byte lead to a node; node 0 is the empty word
        self.child: dict[tuple[int, int], int] = {}
        self.token = [b""]
        self.inner = [False]
        for word in ranks:
            node = 0
            for b in word:
                nxt = self.child.get((node, b))
                if nxt is None:
                    nxt = self.child[node, b] = len(self.token)
                    self.token.append(b"")
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = word
        self.follows = lru_cache(maxsize=PAIRS)(self._follows)
        self.counted: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        #: state and byte, as one number, to the next state and the change of the count, as one number
        self.next: dict[int, int] = {}
        self._intern(((0, b"", 0),))

    def _intern(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.state)
            self.state.append(state)
        return n

    def merged(self, word: bytes) -> list[bytes]:
        """Byte-pair encoding by its definition: merge the pair of lowest rank, leftmost first."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether the two tokens, side by side, are the encoding of their joined bytes."""
        return self.merged(before + token) == [before, token]

    def _compile(self, state: int, byte: int) -> int:
        grown, last, fewer = [], b"", 0
        for node, before, less in self.state[state]:
            node = self.child.get((node, byte), -1)
            if node < 0:
                continue
            token = self.token[node]
            if token and not last and (not before or self.follows(before, token)):
                last, fewer = token, less
            if self.inner[node]:
                grown.append((node, before, less))
        change = 1 - fewer
        new = ((0, last, 0), *((node, before, less + change) for node, before, less in grown))
        got = self.next[state << 8 | byte] = self._intern(new) << 16 | change + 0x8000
        return got

    def count(self, piece: str) -> int:
        """Tokens of one pre-token: the sum of what its transitions emit."""
        total, state = 0, 0
        known, compiled = self.next.get, self._compile
        for byte in piece.encode():
            to = known(state << 8 | byte) or compiled(state, byte)
            state = to >> 16
            total += (to & 0xFFFF) - 0x8000
        return total

    def count_cut(self, cut: str) -> int:
        """Tokens of text that begins and ends where pre-tokens do."""
        n = self.counted.get(cut)
        if n is None:
            if len(self.state) > STATES:
                self._forget()
            n = sum(map(self.count, PRE_TOKEN.findall(cut)))
            if len(self.counted) < COUNTED:
                self.counted[cut] = n
        return n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the text left open before it: ``head`` joins it. Where ``closes`` is set, an edge
    follows; ``tokens`` are those between the first edge and the last, and ``tail``, from there on, is left open."""

    head: str
    closes: bool = False
    tokens: int = 0
    tail: str = ""


def chunk_map(text: str, t: Transducer) -> ChunkMap:
    first, space, rest = text.partition(" ")
    if first and space and not DOUBTFUL.search(text):  # every space is an edge, whatever stands around the chunk
        *inner, tail = rest.split(" ")
        known, total = t.counted.get, 0
        for w in inner:
            n = known(w := " " + w)
            total += t.count_cut(w) if n is None else n
        return ChunkMap(first, True, total, " " + tail)
    edges = [m.start() for m in EDGE.finditer(text)]
    if not edges:
        return ChunkMap(text)
    total = sum(t.count_cut(text[a:b]) for a, b in zip(edges, edges[1:], strict=False))
    return ChunkMap(text[:edges[0]], True, total, text[edges[-1]:])


def compose(a: ChunkMap, b: ChunkMap, t: Transducer) -> ChunkMap:
    """First ``a``, then ``b``; associative. The text open between them may hold an edge where they meet."""
    seam = chunk_map((a.tail if a.closes else a.head) + b.head, t)
    parts = [seam.head, seam.tail] if seam.closes else [seam.head]
    tokens, head = a.tokens + seam.tokens + b.tokens, a.head
    closed = parts if b.closes else parts[:-1]
    tail = b.tail if b.closes else parts[-1]
    if not a.closes:
        if not closed:
            return ChunkMap(tail)
        head, *closed = closed
    return ChunkMap(head, True, tokens + sum(map(t.count_cut, closed)), tail)


def scan(maps: list[ChunkMap], t: Transducer) -> ChunkMap:
    """The maps in order as one, by halves."""
    while len(maps) > 1:
        maps = [compose(*maps[i:i + 2], t) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else ChunkMap("")


class TokenCounter:
    """Counts what ``encode(text, add_special_tokens=False)`` of a byte-level tokenizer file returns."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before, added = said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
        if (said["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space")
                or said.get("normalizer") or said["model"].get("ignore_merges") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)):
            raise ValueError("only plain byte-level BPE files can be compiled")
        letter = _byte_letters()
        spell = lambda w: bytes(letter[c] for c in w)
        ranks = {bytes([b]): -1 for b in range(256)}
        for rank, m in enumerate(said["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(spell(left + right), rank)
        self.transducer = Transducer(ranks)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in added)) if added else None

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string counts as one and parts the text."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def _plain(self, text: str) -> int:
        t = self.transducer
        whole = scan([chunk_map(text[i:i + CHUNK], t) for i in range(0, len(text), CHUNK)], t)
        return whole.tokens + t.count_cut(whole.head) + (t.count_cut(whole.tail) if whole.closes else 0)


_MADE: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's counter for this file; it lives as long as the worker does."""
    if path not in _MADE:
        _MADE[path] = TokenCounter(path)
    return _MADE[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, most: int = MOST_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``.

    Null text is empty and has no tokens; repeated rows and null ids stay rows of their own; an empty
    table gives an empty result; other columns are ignored. There is no shuffle.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            n = [count(x) for some in some_texts(b.column(2)) for x in some]
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > most for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
