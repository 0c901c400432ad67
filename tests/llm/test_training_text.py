"""Operators for training text against brute force, exact round trips and the cases that data can hold."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from markset.llm import disclosure, jaccard, language, line_quality, mixing, neighbours, packing, ranking, records, tokens, transducer
from markset.llm.common import scratch, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, node string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PERSONAL = "mail a.b@c-d.org or x@y.z.w, 1.2.3.4 256.1.1.1 card 4111 1111 1111 1111, +1 (499) 555-6503 +12 é👍 q@w.e%r@t.y 1.2.3.4.5.6.7.8 0001.02.3.255"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "Tion", "and", "Ère", "haut", "don't", "l'été", "und", "naïve", "日本", "x1", "re,", "a.b@c.de", "10.0.0.1"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 120, 400]))) for _ in range(60)]
    texts += [t + " more" for t in texts[:20]] + texts[:10]
    texts += [None, "", "   \n\t ", "word", "a\x1cb \x85c", "x" * 5000, "12 " * 9000, "a  b\n\n c\t d ", "<|endoftext|> a<|endoftext|>", PERSONAL, PERSONAL * 40]
    out = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3", "é"][min(i % 9, 4)], None, "x", "y", "z") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "null id here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_ids_equal_the_library(library, rows):
    texts = [r[1] or "" for r in rows]
    for got, t in zip(tokens.TokenIds(tokenizer_path()).encode(texts), texts, strict=True):
        assert got.tolist() == ids_of(library, t)[:-1]


@pytest.mark.parametrize("chunk", [7, 40, 1 << 15])
def test_transducer_counts_equal_the_library(library, rows, chunk, monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    count, rng = transducer.TokenCounter(tokenizer_path()), random.Random(chunk)
    odd = ["".join(rng.choice(" \n\t'abstre123.,é日<|>-_\x85\x1c") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in [r[1] or "" for r in rows] + odd:
        assert count.count(t) == len(ids_of(library, t)) - 1


def test_token_counts(docs, none, rows, library):
    got = Counter(tuple(r) for r in transducer.count_tokens(docs).collect())
    n = [(r[0], len((r[1] or "").encode()), len(ids_of(library, r[1])) - 1) for r in rows]
    assert got == Counter((*x, x[2] > 512) for x in n)
    assert transducer.count_tokens(none).count() == 0


def test_plan_holds_every_length_once():
    rng = random.Random(1)
    for n in (0, 1, 40, 3000):
        counts = Counter(min(2048, int(rng.expovariate(1 / 600)) + 1) for _ in range(n))
        made, held = packing.plan(counts), Counter()
        for times, runs in made:
            assert sum(a * k for a, k in runs) <= 2048
            for a, k in runs:
                held[a] += times * k
        assert held == counts
        least = -(-sum(a * k for a, k in counts.items()) // 2048)
        assert sum(t for t, _ in made) <= least * 1.02 + 1
    assert packing.plan(Counter({2047: 3, 1: 3})) == [(3, ((2047, 1), (1, 1)))]
    assert packing.plan(Counter({1000: 2, 600: 2, 448: 2}))[0] == (2, ((1000, 1), (600, 1), (448, 1)))


def test_packing_places_every_piece(docs, none, rows, library):
    got = packing.pack(docs).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for r in rows:
        ids = ids_of(library, r[1])
        for k, (s, n) in enumerate(packing.cut_lengths(len(ids))):
            want[r[0], k, s, n, crc(ids[s:s + n])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack(none).count() == 0


def test_records_round_trip(spark, docs, none, rows, library):
    got = records.round_trip(docs, scratch(spark, "t")).collect()
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(library, r[1])
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert records.round_trip(none, scratch(spark, "t")).count() == 0


def test_damaged_record_raises():
    data = bytearray(records.frame(7, np.array([1, 2, 70_000], np.uint32)))
    assert records.unframe(bytes(data))[1].tolist() == [1, 2, 70_000]
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def spans_of(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and max(map(int, m.group().split("."))) <= 255
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_personal_data_base_spans(docs, none, rows):
    out = disclosure.sanitise(docs).select("doc_id", "text", disclosure.written(disclosure.F.col("base")).alias("b"), "sanitised").collect()
    assert Counter((r["doc_id"], r["text"], r["b"]) for r in out) == Counter((r[0], r[1], spans_of(r[1])) for r in rows)
    assert all("4111 1111" not in (r["sanitised"] or "") and (r["sanitised"] is None) == (r["text"] is None) for r in out)
    assert disclosure.sanitise(none).count() == 0


def test_telling_terms_go_and_common_ones_stay(spark):
    words = ["apple", "pear", "plum", "fig"]
    texts = [f"the {words[i % 4]} of Zebediah is at z@home.org since {'abcdefgh'[i]}{i}" for i in range(4)] + [f"the {words[i % 4]} fell on day {i}" for i in range(200)]
    out = disclosure.sanitise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    held = [r for r in out if r["doc_id"] < 4]
    assert all("Zebediah" not in r["sanitised"] and "[email]" in r["sanitised"] and "the " in r["sanitised"] for r in held)
    assert all(r["sanitised"] == r["text"] for r in out if r["doc_id"] >= 4)


def test_a_telling_term_far_from_its_entity_goes(spark):
    far = lambda i: " ".join(f"{'abcdefgh'[k % 8] * 3}{i}" for k in range(40))
    texts = [f"first line\nZebediah {far(i)} z@home.org {far(i)} Ottoline\nlast line" for i in range(4)] + [f"day {i} {far(i)}" for i in range(200)]
    out = disclosure.sanitise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    held = [r["sanitised"] for r in out if r["doc_id"] < 4]
    assert len(held) == 4 and all("Zebediah" not in t and "Ottoline" not in t and "first line" in t and "[email]" in t for t in held)


def test_copies_of_a_context_leave_its_terms_telling(spark):
    texts = [f"Zebediah is at z@home.org since {x}" for x in ("may", "june", "july")] + ["Zebediah is at z@home.org since may"] * 2000 + [f"it is day {i}" for i in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    held = df.withColumn("base", disclosure.base_spans(disclosure.F.col("text"))).where("size(base) > 0").distinct()
    got = {(r["entity"], r["term"]): r["share"] for r in disclosure.disclosing_terms(held, df).collect()}
    assert set(got) == {("email:z@home.org", "zebediah"), ("email:z@home.org", "since")} and all(abs(x - 1) < 1e-9 for x in got.values())


def test_overlapping_spans_go_whole(spark):
    texts = ["pay 4111 1111 1111 1111bob@x.org now", "1.2.3.4@x.org", "+4111111111111111 a"]
    out = disclosure.sanitise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["sanitised"] for r in out} == {0: "pay [card][email] now", 1: "[email]", 2: "+[card] a"}


def sets_of(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_components(docs, none, rows):
    sets = [sets_of(r[1]) for r in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in set(part)}
    want = Counter((r[0], len(s), least[p]) for r, s, p in zip(rows, sets, part, strict=True))
    assert Counter(tuple(r) for r in jaccard.join_components(docs).collect()) == want
    assert jaccard.join_components(none).count() == 0
    kept = [r["doc_id"] for r in jaccard.one_per_component(docs).where("doc_id is not null").collect()]
    assert Counter(kept) == Counter({i for i, _, c in want if i is not None and i == c})


def test_linked_sets_meet_in_a_list_they_keep():
    rng, linked = random.Random(0), 0
    for _ in range(2000):
        n = rng.choice([1, 2, 4, 5, 8, 9, 10, 12, 20, 60, 300])
        pool = [rng.getrandbits(64) for _ in range(2 * n + 5)]
        a = set(pool[:n])
        b = (a - set(rng.sample(sorted(a), rng.randint(0, n // 5)))) | set(pool[n:n + rng.randint(0, max(1, n // 8))])
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        linked += 1
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert jaccard.may_link(len(x), jaccard._words([jaccard.sketch(x), jaccard.sketch(y)])[0], len(y), jaccard._words([jaccard.sketch(x), jaccard.sketch(y)])[1])
        for boundary in (0, 9):
            (ka, ta), (kb, tb) = jaccard.list_keys(x, boundary), jaccard.list_keys(y, boundary)
            order = {k: rng.random() for k in set(ka.tolist()) | set(kb.tolist())}

            def kept(keys, tags, order=order):
                out = set()
                for t in set(tags.tolist()):
                    mine = sorted(keys[tags == t].tolist(), key=order.get)
                    out |= set(mine[:len(mine) - (t & 0xFFFF)])
                return out

            assert kept(ka, ta) & kept(kb, tb)
    assert linked > 1000


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(12, size=1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[5] = x[6] = x[7] = x[40]
    broken = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15]
    data = [(i, x[i].tolist(), "c") for i in range(1500)] + [(2000 + 20 * i, v, None) for i, v in enumerate(broken)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, node string")
    got = neighbours.nearest(df, neighbours.F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    found = total = 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(1500), -np.round(score, 12))) if i != q][:20]
        total += 20
        found += len(set(want) & {i for i, _ in by.get(q, [])})
        assert [i for i, _ in by[q]] == sorted((i for i, _ in by[q]), key=lambda i: (-round(float(score[i]), 12), i))
    assert found / total >= 0.9
    assert max(by) < 1500
    assert neighbours.nearest(df.limit(0), neighbours.F.col("vec_id") % 20 == 0).count() == 0


def test_language_known_and_undetermined(spark, none):
    say = {"en": "the house and the garden are with the old man of that town", "de": "das haus und der garten sind bei dem alten mann der stadt",
           "fr": "la maison et le jardin sont avec le vieil homme de cette ville"}
    rng = random.Random(0)
    data = [(i, " ".join(rng.sample(say[k].split(), 8)), k) for i in range(90) for k in say] + [(900, None, "en"), (901, "", None), (902, "12 34 !", "de"), (903, "the old garden", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.learn(df)
    got = {(r["doc_id"], i): r for i, r in enumerate(language.identify(df, model).collect())}
    names = [r["lang_pred"] for r in got.values()]
    assert sum(p == d[2] for p, d in zip(names, data, strict=True) if d[2] and d[0] < 900) >= 265
    assert names[-4:] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.learn(none) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    assert language.codewords(12).shape[0] == 12 and len({tuple(r) for r in language.codewords(12).tolist()}) == 12


def repeats(words):
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(inside)


def test_line_rules(docs, none, rows):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in line_quality.judge_lines(docs).collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        again = repeats(w)
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, len(w) < 50 or 100 * again > 50 * len(w)] += 1
    assert got == want
    assert line_quality.judge_lines(none).count() == 0


def test_common_lines_deplete_a_document(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    menu = "Home  About " + " ".join(f"m{k}" for k in range(200))
    data = [(i, f"{menu}\n{own(i)}" if i else f"{menu.upper()}\n{' '.join(own(i).split()[:20])}", "h") for i in range(15)]
    data += [(100 + i, own(100 + i) + "\nshort", "other") for i in range(15)] + [(200, f"{menu}\n{own(200)}", "third")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_quality.judge_lines(df, least_left=0.2).collect()}
    assert got[0]["removed_words"] == 202 and not got[0]["kept"] and got[1]["kept"] and got[200]["removed_words"] == 0
    left = {r["doc_id"]: r["text"] for r in line_quality.without_common_lines(df).collect()}
    assert left[1] == own(1) and left[100] == own(100) and left[200] == data[-1][1]


def test_common_lines_are_the_same_at_every_size_of_a_host(spark):
    F = line_quality.F
    text = F.concat(F.when(F.col("id") < 12, F.lit("shared by twelve\n")).when(F.col("id") < 21, F.lit("shared by nine\n")).otherwise(F.lit("")), F.lit("own"), F.col("id").cast("string"))
    for n in (100, 100_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("h").alias("source"))
        assert line_quality.common_lines(docs).count() == 1
        assert line_quality.judge_lines(docs).where("removed_words = 3").count() == 12


def test_copies_under_other_ids_are_documents_of_their_own(spark):
    page = "\n".join(f"line {k} " + " ".join(f"w{k}x{j}" for j in range(20)) for k in range(5))
    data = [(i, page, "copies") for i in range(12)] + [(100, page, "rows")] * 12 + [(None, page, "null")] * 12
    got = Counter((r["doc_id"] if r["doc_id"] is None else min(r["doc_id"], 100) // 100, r["removed_words"], r["kept"]) for r in line_quality.judge_lines(spark.createDataFrame(data, "doc_id long, text string, source string")).collect())
    assert got == {(0, 110, False): 12, (1, 0, True): 12, (None, 0, True): 12}


def test_mixing_meets_targets(docs, none, rows):
    plan = mixing.mix_plan(mixing.sized(docs)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, total, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    free = set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2 * sizes[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"] * r["times"]
    largest = max(len(WORD.findall(r[1] or "")) for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    again = mixing.mix_plan(mixing.sized(docs.repartition(7))).collect()
    assert Counter((r["doc_id"], r["text_key"], r["copies"]) for r in plan) == Counter((r["doc_id"], r["text_key"], r["copies"]) for r in again)
    assert mixing.mix_documents(docs).count() == sum(r["copies"] * r["times"] for r in plan)
    assert mixing.mix_plan(mixing.sized(none)).count() == 0


def test_cube_flight_keeps_both_totals():
    rng = random.Random(3)
    size, p = [float(rng.randint(0, 900)) for _ in range(2000)], [0.37] * 2000
    out = mixing.fly(list(size), list(p), 1)
    assert sum(0 < v < 1 for v in out) <= 2
    assert abs(sum(out) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(size, out, strict=True)) - 0.37 * sum(size)) < 1e-3


def test_ranking_parts_labels(spark, none):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["the", "house", "is", "red", "and", "warm"]) + str(rng.choice("abc")) for _ in range(60)) + "."
    data = [(i, good() if i % 5 else good().upper().replace(" ", "!! ")) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(200)] + [(901, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in ranking.score_documents(df, ranking.learn(df, labels)).collect()}
    assert all(got[i]["accepted"] == (i % 5 > 0) for i in range(200))
    assert got[900]["score"] == got[901]["score"] and 0 <= got[900]["score"] <= 1
    blank = ranking.learn(df, labels.limit(0))
    assert all(r["accepted"] for r in ranking.score_documents(df, blank).collect())
    assert ranking.score_documents(none, blank).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs, counts = before, [before.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "t")
        assert docs.columns == before.columns
        counts.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert counts[0] > counts[1] > counts[2] == counts[3] and packed.where("piece = 0").count() == counts[4]
    assert not docs.where(docs.text.rlike(BASE["email"])).count()


def test_digest_of_the_base_query(spark):
    got = {r["doc_id"]: r["base_sha256"] for r in disclosure.op1_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert got[r["doc_id"]] == hashlib.sha256(spans_of(r["text"]).encode()).hexdigest()


def test_ranking_pairs_take_every_labelled_row(spark):
    rows = spark.range(37).selectExpr("cast(id < 4 as int) AS quality", "id AS doc_id", "cast(id AS double) AS f0")
    got = [r["f0"] for r in ranking.preference_pairs(rows, ["f0"], {0: 33, 1: 4}, pairs=20).collect()]
    assert len(got) == 80 and len(set(got)) > 33
    some = ranking.preference_pairs(rows, ["f0"], {0: 33, 1: 4}, pairs=2)
    assert some.count() == 33  # more than pairs asked for: each of the commoner label once


def test_ranking_learns_from_every_label(spark, monkeypatch):
    df = spark.createDataFrame([(i, "good words stand here. " * 3 if i % 4 else "# bad $ % words & " * 3) for i in range(80)], "doc_id long, text string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) AS quality")
    seen, fit = [], ranking.fit_pairs
    monkeypatch.setattr(ranking, "fit_pairs", lambda d: seen.append(d.count()) or fit(d))
    model = ranking.learn(df, labels)
    assert seen == [ranking.PAIRS * 20]
    assert all(r["accepted"] == (r["doc_id"] % 4 > 0) for r in ranking.score_documents(df, model).collect())


def test_ranking_parts_scores_at_the_mass(spark):
    s = spark.createDataFrame([(float(v), 1.0) for v in (5, 1, 2, 2, 2, 9)], "s double, mass double")
    assert [ranking.parting(s, k, 1.0) for k in (1, 2, 3, 4, 5)] == [1.5, 2.0, 2.0, 3.5, 7.0]


def test_ranking_joins_features_not_texts(spark):
    """What meets the labels holds no text, and gives the model and the scores that the texts give."""
    df = spark.createDataFrame([(i, None if i == 3 else "plain words of a text " * (1 + i % 5) if i % 4 else "#### $$ %% !!") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 60, 2)], "doc_id long, quality int")
    rows = ranking.featured(df)
    assert "text" not in rows.columns and rows.count() == 60
    model, of_texts = ranking.learn_from(rows, labels), ranking.learn(df, labels)
    assert model.weights == pytest.approx(of_texts.weights, abs=1e-6) and model.threshold == pytest.approx(of_texts.threshold, abs=1e-6)
    want = {r["doc_id"]: r["score"] for r in ranking.score_documents(df, model).collect()}
    assert {r["doc_id"]: r["score"] for r in ranking.score_featured(rows, model).collect()} == pytest.approx(want, abs=1e-12)
