"""Decontamination, collocations and periodic runs against brute force and the cases that data can hold."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from markset.llm import collocations, decontaminate, periods

DOCS = "doc_id long, text string, lang string, source string, window string, at string, key string, phrase string"
ITEMS = "item_id long, text string, window string"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TAIL = ("w", "a", "k", "p")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def items():
    rng = random.Random(2)
    long = [" ".join(rng.choice("ab") + str(rng.randrange(9)) for _ in range(n)) for n in (10, 14, 30, 30)]
    texts = [*long, long[2], "Three short words.", "É", None, "", "...", "one two three four five six seven eight nine"]
    return [*((i, t, "x") for i, t in enumerate(texts)), (11, long[0], "x"), (11, "under one id", "x"), (None, "has no id", "x")]


@pytest.fixture(scope="module")
def rows(items):
    rng = random.Random(4)
    texts = [None, "", " \n", "É é ÉÉ", "three-short, WORDS and three short words", "has no id; under one id", "x" * 3000, "ab " * 4000]
    for i in range(60):
        own = " ".join(rng.choice("abc") + str(rng.randrange(9)) for _ in range(rng.randrange(60)))
        taken = items[rng.randrange(4)][1].split()
        k = rng.randrange(len(taken))
        texts.append(f"{own}. {' '.join(taken[k:k + rng.randrange(40)]).upper()}, ¡{own[:9]}")
    texts += [(items[2][1] + " ") * 30, items[0][1] + " " + items[0][1], items[3][1].replace(" ", " -- ")]
    out = [(i, t, *TAIL[:2], *TAIL) for i, t in enumerate(texts)]
    return [*out, out[-1], out[-1], (out[-1][0], "same id", *out[-1][2:]), (None, items[2][1], *out[0][2:]), (None, None, *out[0][2:])]


def contaminated(rows, items, size=10):
    known = {}
    for item, text, _ in items:
        w = TOKEN.findall(lower(text))
        k = min(len(w), size)
        for i in range(len(w) - k + 1 if k else 0):
            known.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = Counter()
    for doc_id, text, *_ in rows:
        w, hit, found = TOKEN.findall(lower(text)), set(), set()
        for k in {len(x) for x in known}:
            for i in range(len(w) - k + 1):
                if (names := known.get(tuple(w[i:i + k]))):
                    hit |= set(range(i, i + k))
                    found |= names
        out[doc_id, len(w), tuple(sorted(hit)), tuple(sorted(found))] += 1
    return out


def test_contamination_equals_brute_force(spark, rows, items, monkeypatch):
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = contaminated(rows, items)
    for sent in (1_000_000, 7):  # in one part and in several
        monkeypatch.setattr(decontaminate, "SENT", sent)
        got = Counter((r["doc_id"], r["n_words"], tuple(r["hit_words"]), tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect())
        assert got == want
    ten = [x for x in items if len(TOKEN.findall(lower(x[1]))) >= 10]
    got = decontaminate.contamination(docs, spark.createDataFrame(ten, ITEMS)).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple(r["hit_words"]), tuple(r["items"])) for r in got) == contaminated(rows, ten)


def test_contamination_of_empty_tables(spark, rows, items):
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    clean = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["hit_words"] or r["items"] for r in clean)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_spans_or_documents_go(spark, items):
    text = f"Before, it said: {items[1][1]}! After é."
    docs = spark.createDataFrame([(1, text, "keep"), (2, "clean", "keep"), (3, None, "keep"), (4, items[1][1], None)], "doc_id long, text string, at string")
    bench = spark.createDataFrame(items[:4], ITEMS)
    got = {r["doc_id"]: tuple(r) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (1, "Before, it said: After é.", "keep"), 2: (2, "clean", "keep"), 3: (3, None, "keep"), 4: (4, "", None)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, spans=False).collect()} == {2, 3}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs.withColumn("_hit_key", docs.doc_id), bench)


def test_contamination_runs_no_python(spark):
    plan = decontaminate.op11_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def phrase_counts(rows):
    n, f = Counter(), {}
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    c = f.setdefault((lang, tuple(w[i:i + k])), 0)
                    f[lang, tuple(w[i:i + k])] = c + 1
    return n, f


def best_phrases(rows, least=10, top=2000):
    n, f = phrase_counts(rows)
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        s, _, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, k) for k in range(1, len(p)))
        if len(p) == 2 and any(100 * f[lang, q] >= 50 * a and f[lang, q] >= least for g, q in f if g == lang and len(q) == 3 and p in (q[:2], q[1:])):
            continue
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, ps in out.items() for i, (s, a, p, x, y) in enumerate(sorted(ps)[:top])]


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(9)
    vocabulary = ["the", "New", "york", "times", "é", "日本", "a\x00b", "x-y", "\x1c", "of"]
    texts = [" ".join(rng.choices(vocabulary, range(1, 11), k=rng.randrange(1, 90))) + rng.choice([".", "\n", ""]) for _ in range(60)]
    texts += [None, "", " . , ", "new york\ttimes; new york times", "long " * 20_000, "\x0b\x0cin\x0bdeed\rno"]
    out = [(i, t, [None, "en", "und", "fr"][i % 4], None, *TAIL) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, *out[7][1:])]


@pytest.mark.parametrize(("least", "one_of", "bits"), [(10, 8, 27), (3, 40, 27), (2, 2, 8)])
def test_collocations_equal_brute_force(spark, phrases, least, one_of, bits, monkeypatch):
    monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (one_of,))
    monkeypatch.setattr(collocations, "BITS", bits)  # a crowded table proposes too much and changes nothing
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame(phrases, DOCS).repartition(3), least, 25).collect()]
    assert sorted(got) == sorted(best_phrases(phrases, least, 25))


def test_counts_of_phrases_are_exact(spark, phrases):
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in collocations.frequent_phrases(spark.createDataFrame(phrases, DOCS), 4, one_of=50).where("words > 0").collect()}
    assert got == {k: v for k, v in phrase_counts(phrases)[1].items() if v >= 4}
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_scores_beyond_64_bits(spark):
    a, x, y = 3 * 10 ** 9 + 7, 4 * 10 ** 9 + 1, 5 * 10 ** 9 + 3
    got = spark.createDataFrame([(a, x, y)], "a long, l long, r long").select(collocations._score(collocations.F.col("l"), collocations.F.col("r"))).first()[0]
    assert got == 10 ** 6 * a * a // (x * y)


def runs_of(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(6, 4 * p) and not any(w[i:i + length - q] == w[i + q:i + length] for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, w = rng.choice([1, 2, 3, 30]), []
            while len(w) < rng.randint(0, 120):
                unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
                w += (unit * rng.randint(1, 9))[:rng.randint(1, 80)] if rng.random() < 0.4 else unit
            texts.append(w)
        got = periods.find_runs([np.array(w, np.int64) for w in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [runs_of(w) for w in texts]


def test_common_extensions_equal_brute_force():
    rng = random.Random(6)
    texts = [[rng.randrange(2) for _ in range(n)] for n in (1, 90, 40)] + [[0] * 70, [0, 1] * 40]
    words, text = np.array(sum(texts, [])), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if text[i] == text[j]]
    got = periods.CommonExtension(words, text)(*(np.array(c) for c in zip(*pairs, strict=True)))
    for (i, j), n in zip(pairs, got.tolist(), strict=True):
        k = 0
        while j + k < len(words) and text[j + k] == text[i] and words[i + k] == words[j + k]:
            k += 1
        assert n == k


def want_periods(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[2] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_of_documents(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randrange(90))) for _ in range(300)]
    texts += [None, "", " \n\t", "a " * 3000, "a\x1cb \x85 " * 9, "ab ab AB ab\nab\tab ab ab ab ab", "é 日 " * 40]
    data = [(i, t, None, None, *TAIL) for i, t in enumerate(texts)]
    data += [data[3], data[3], (None, "x y " * 8, None, None, *TAIL), (None, None, None, None, *TAIL)]
    spark.createDataFrame(data, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(want_periods(r[0], r[1]) for r in data)
    assert periods.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_periodic_runs_of_the_given_table(spark):
    got = Counter(tuple(r) for r in periods.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == Counter(want_periods(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 20_000) + Counter(
        x for x in got if x[0] in {r["doc_id"] for r in docs if len(r["text"] or "") >= 20_000})
