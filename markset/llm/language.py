"""Language identification by error-correcting output codes.

Each language has a codeword; each bit splits the languages in two groups and has a binary classifier
on byte n-grams, the mean log-odds of a text's n-grams between the groups. Counts of n-grams come from
all training texts. A text is decoded to the codeword with the least loss, each bit weighed by how well
it did on training texts; a text whose two nearest codewords are about as near is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markset.llm.common import id_hash_is, table

UNDETERMINED = "und"
BUCKETS = 1 << 14
#: Training texts, by the hash of their ids, on which the weights of the bits are measured.
MEASURED = 4000
#: Bytes of text handled at a time.
STEP = 1 << 20
#: Nearest and next codeword closer than this share of the loss make a text ambiguous.
AMBIGUOUS = 0.2
#: How steeply the loss follows a bit's mean log-odds per n-gram.
STEEP = 8.0
#: Languages up to which every split of them is a bit.
EXHAUSTIVE = 6

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def codewords(languages: int, seed: int = 0) -> np.ndarray:
    """A matrix of +1 and -1, a row per language: all splits where they are few, else random ones of which
    the draw with the largest least distance between rows is taken."""
    if languages <= EXHAUSTIVE:
        splits = range(1, 1 << max(languages - 1, 0))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)]).reshape(languages, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, far = None, -1
    for _ in range(50):
        m = rng.choice([-1, 1], size=(languages, bits))
        m[0] = np.where(np.abs(m.sum(0)) == languages, -m[0], m[0])  # a bit must part the languages
        d = (bits - m @ m.T) / 2 + np.eye(languages) * bits
        if d.min() > far:
            best, far = m, d.min()
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of one to three bytes of all texts, ``(3, bytes)``, and where each text begins."""
    folded = [t.lower().encode().translate(_FOLD) + b"  " for t in texts]
    at = np.cumsum([0, *map(len, folded)])[:-1]
    b = np.frombuffer(b"".join(folded) + b"  ", np.uint8).astype(np.uint32)
    one = b[:-2] + np.uint32(1)
    two = one * np.uint32(257) + b[1:-1] + np.uint32(1)
    three = two * np.uint32(257) + b[2:] + np.uint32(1)
    return np.stack([(c * np.uint32(2654435761)) >> np.uint32(18) for c in (one, two, three)]), at


def _steps(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``STEP`` characters, each with the number of its first text."""
    step, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield step, texts[step:k + 1]
            step, size = k + 1, 0
    if step < len(texts):
        yield step, texts[step:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` over all of ``docs(text, lang)``: each task sums what it reads, then the tasks' sums are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, some in _steps(texts):
                    total += np.bincount(grams(some)[0].ravel(), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                                             names=["lang", "bucket", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """Names and codewords, the bits' n-gram weights ``(BUCKETS, bits)`` and their weights in decoding."""

    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log-odds per n-gram of each text and bit."""
        out = np.zeros((len(texts), self.code.shape[1]), np.float32)
        for first, some in _steps(texts):
            g, at = grams(some)
            total = sum(np.add.reduceat(self.weights[row], at, axis=0) for row in g)
            length = np.diff(np.append(at, g.shape[1]))
            out[first:first + len(some)] = total / (3 * length)[:, None]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each text for each language, between 0 and about 1."""
        each = np.logaddexp(0, -STEEP * margins[:, None, :] * self.code[None, :, :])
        return (each * self.trust).sum(2) / max(self.trust.sum(), 1e-9)

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, scores from 0 to 1 and whether each text is ambiguous."""
        loss = self.losses(self.margins(texts))
        best = loss.argmin(1)
        like = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        score = like.max(1) / like.sum(1)
        two = np.sort(loss, 1)[:, :2] if len(self.names) > 1 else np.tile([0.0, 9.0], (len(texts), 1))
        return [self.names[k] for k in best], score, two[:, 1] - two[:, 0] < AMBIGUOUS * two[:, 1]


def learn(docs: DataFrame) -> Languages | None:
    """Codewords and classifiers from ``docs(doc_id, text, lang)``; rows with null text or lang are left out.

    The model has ``BUCKETS`` weights per bit and about ten bits per doubling of the languages, whatever the
    size of the corpus. Without any training text there is none.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = gram_counts(known).toPandas()
    names = sorted(counts["lang"].unique())
    if not names:
        return None
    n = np.zeros((len(names), BUCKETS))
    n[counts["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    share = n / n.sum(1, keepdims=True)
    code = codewords(len(names))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        with_, without = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weights[:, b] = np.log((with_ + 1e-6) / (without + 1e-6))
    model = Languages(names, code, weights, np.ones(code.shape[1]))
    return Languages(names, code, weights, _trust(known, model)) if code.shape[1] else model


def _trust(known: DataFrame, model: Languages) -> np.ndarray:
    """Log-odds of each bit being right on ``MEASURED`` training texts."""
    number = {x: k for k, x in enumerate(model.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [number[x] for x in b.column(1).to_pylist()]
            right = model.margins(b.column(0).to_pylist()) * model.code[rows] > 0
            yield pa.RecordBatch.from_arrays([pa.array(right.sum(0).tolist() and [right.sum(0).tolist()], pa.list_(pa.int64())), pa.array([len(rows)], pa.int64())],
                                             names=["right", "n"])

    ids = known.select(F.xxhash64("doc_id", "text").alias("k")).orderBy("k").limit(MEASURED)
    edge = ids.agg(F.max("k")).first()[0]
    got = known.where(F.xxhash64("doc_id", "text") <= edge).select("text", "lang").mapInArrow(run, "right array<long>, n long").collect()
    right, n = sum(np.array(r["right"]) for r in got), sum(r["n"] for r in got)
    p = (right + 1) / (n + 2)
    return np.clip(np.log(p / (1 - p)), 0.1, None)


def identify(docs: DataFrame, model: Languages | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous per row of ``docs(doc_id, text)``.

    Null texts and texts without a letter are ``und`` with score 0, as all are without a model; rows that
    repeat are predicted alike; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            at = [k for k, t in enumerate(texts) if model and t and _LETTER.search(t)]
            names, score, close = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if at:
                found, score[at], close[at] = model.decode([texts[k] for k in at])
                for k, name in zip(at, found, strict=True):
                    names[k] = name
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(close)],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~id_hash_is(4, 2)))
    return identify(docs, model).select("doc_id", id_hash_is(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
