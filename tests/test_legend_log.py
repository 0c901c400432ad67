"""Replay of mixed edit logs against a plain sequential one."""

import random
import re

import pytest

from markset.operators.legend_log import replay_log

ENTRY = "legend_id string, position long, entry_id string, tag string, tag_source string, name string, description string, grp string, counted boolean, confirmed boolean, flags array<string>, source string, symbol_boxes array<array<double>>"
EDIT = "legend_id string, seq long, op string, entry_id string, value string, tag string, name string, grp string, description string, symbol_boxes array<array<double>>"


def initials(name):
    return "".join(w[0] for w in re.findall("[A-Za-z0-9]+", re.sub(r"\([^)]*\)", " ", name)))[:3].upper() or "S"


def free(letters, taken):
    n = 1
    while (letters if n == 1 else f"{letters}{n}") in taken:
        n += 1
    return letters if n == 1 else f"{letters}{n}"


def titled(text):
    text = " ".join(text.lower().split(",")[0].split())
    return text[:1].upper() + text[1:] if text else "Symbol"


def sequential(entries, edits):
    """Walks the log with lists, looking at all tags after each edit that can change one."""
    kept, refused, made = [dict(e) for e in entries], [], max([int(e["entry_id"][1:]) for e in entries], default=0)
    for r in sorted(edits, key=lambda r: r["seq"]):
        problem, looks = None, True
        e = next((x for x in kept if x["entry_id"] == r["entry_id"]), None)
        v = (r["value"] or "").strip()
        usable = lambda t: re.fullmatch(r"[A-Z0-9][A-Z0-9\-./]{0,7}", t) is not None
        if r["op"] == "add":
            b, tag = (r["symbol_boxes"] or [None])[0], r["tag"] and r["tag"].strip().upper()
            if b is None or b[2] - b[0] < 4 or b[3] - b[1] < 4:
                problem = "no_box" if b is None else "small_box"
            elif tag and not usable(tag):
                problem = "unusable_tag"
            else:
                made += 1
                name = r["name"] or (titled(r["description"]) if r["description"] else "New symbol")
                kept.append({"entry_id": f"L{made}", "tag": tag or free(initials(name), {x["tag"] for x in kept}), "tag_source": "user" if tag else "generated", "name": name, "description": r["description"] or "",
                             "grp": r["grp"], "counted": True, "confirmed": True, "flags": [] if tag else ["generated_tag"], "source": "user", "symbol_boxes": [b]})
        elif e is None:
            problem = "no_such_entry"
        elif r["op"] in ("rename", "set_group"):
            looks = False
            if not v:
                problem = "empty_value"
            elif r["op"] == "set_group":
                e["grp"] = v
            else:
                e["name"] = v
                e["confirmed"] |= "wrapped" in e["flags"]
        elif r["op"] == "set_tag":
            if usable(v.upper()):
                e["tag"], e["tag_source"], e["flags"] = v.upper(), "user", [f for f in e["flags"] if f != "generated_tag"]
            else:
                problem = "unusable_tag"
        elif r["op"] == "set_count":
            e["counted"], looks = v == "true", False
        elif r["op"] == "confirm":
            e["confirmed"], looks = True, False
        elif r["op"] == "delete":
            kept.remove(e)
        elif r["op"] == "merge":
            into = next((x for x in kept if x["entry_id"] == v and x is not e), None)
            if into is None:
                problem = "no_such_target"
            else:
                into["symbol_boxes"], into["counted"] = into["symbol_boxes"] + e["symbol_boxes"], into["counted"] or e["counted"]
                kept.remove(e)
        elif r["op"] == "split":
            boxes = sorted(e["symbol_boxes"], key=lambda b: b[0])
            if len(boxes) < 2:
                problem = "one_drawing"
            else:
                parts = e["description"].split(" / ")
                parts = parts if len(parts) == len(boxes) and len(parts) > 1 else [e["description"]] * len(boxes)
                taken, new = [x["tag"] for x in kept if x is not e], []
                for n, (b, d) in enumerate(zip(boxes, parts)):
                    d = re.sub(r"\((LEFT|RIGHT)\)", "", d).strip(" ,")
                    own = n == 0 and e["tag_source"] != "generated"
                    tag = e["tag"] if own else free(initials(titled(d)), taken)
                    taken.append(tag)
                    made += 1
                    new.append({**e, "entry_id": f"L{made}", "tag": tag, "tag_source": e["tag_source"] if own else "generated", "name": titled(d), "description": d, "symbol_boxes": [b], "source": "user", "confirmed": True,
                                "flags": [f for f in e["flags"] if f not in ("combined", "wrapped", "duplicate_tag", "generated_tag")] + ([] if own else ["generated_tag"])})
                at = kept.index(e)
                kept[at:at + 1] = new
        if problem:
            refused.append((r["seq"], r["op"], r["entry_id"], problem))
        elif looks:
            for x in kept:
                crowd = sum(y["tag"] == x["tag"] for y in kept) > 1
                if crowd and "duplicate_tag" not in x["flags"]:
                    x["flags"], x["confirmed"] = [*x["flags"], "duplicate_tag"], False
                elif not crowd:
                    x["flags"] = [f for f in x["flags"] if f != "duplicate_tag"]
    return kept, refused


def shown(e):
    return (e["entry_id"], e["tag"], e["tag_source"], e["name"], e["description"], e["grp"], e["counted"], e["confirmed"], tuple(e["flags"]), e["source"], tuple(map(tuple, e["symbol_boxes"])))


def test_replay_equals_a_sequential_walk(spark):
    rng = random.Random(5)
    things = ["DUPLEX OUTLET (LEFT)", "SINGLE POLE SWITCH, WALL", "RED BOX / BLUE BOX", "LIGHT (RIGHT) / DARK", "JUNCTION BOX", ""]
    box = lambda: [float(rng.randint(0, 400)), 10.0, float(rng.randint(401, 800)), float(rng.choice([12, 30]))]
    entries, edits = [], []
    for k in range(14):
        ids = [f"L{i + 1}" for i in range(rng.randint(0, 6))]
        for i, name in enumerate(ids):
            d = rng.choice(things)
            entries.append({"legend_id": f"g{k}", "position": i, "entry_id": name, "tag": rng.choice(["A", "B", "RB", "DO", "S"]), "tag_source": rng.choice(["generated", "tag_column"]), "name": titled(d), "description": d, "grp": "Other",
                            "counted": rng.random() < 0.5, "confirmed": rng.random() < 0.5, "flags": rng.choice([[], ["wrapped"], ["combined"]]), "source": "read", "symbol_boxes": [box() for _ in range(rng.randint(1, 3))]})
        for s in range(rng.choice([0, 5, 40])):
            op = rng.choice(["rename", "set_tag", "set_group", "set_count", "confirm", "delete", "merge", "merge", "split", "split", "split", "add", "add"])
            value = {"rename": rng.choice(["New name", "  "]), "set_tag": rng.choice(["a", "B", "x1", "??"]), "set_count": rng.choice(["true", "false"]), "merge": f"L{rng.randint(1, 9)}", "set_group": "Power"}.get(op)
            edits.append({"legend_id": f"g{k}", "seq": s, "op": op, "entry_id": None if op == "add" else f"L{rng.randint(1, 12)}", "value": value, "tag": rng.choice([None, "z9", "!!"]) if op == "add" else None,
                          "name": rng.choice([None, "Own name"]), "grp": "Fire", "description": rng.choice(["", "EXIT SIGN, RED"]), "symbol_boxes": rng.choice([None, [box()]]) if op == "add" else None})
    got, refused = replay_log(spark.createDataFrame(entries, ENTRY).repartition(3), spark.createDataFrame(edits, EDIT).repartition(3))
    by_legend, bad = {}, {}
    for r in got.orderBy("position").collect():
        by_legend.setdefault(r["legend_id"], []).append(shown(r))
    for r in refused.orderBy("seq").collect():
        bad.setdefault(r["legend_id"], []).append((r["seq"], r["op"], r["entry_id"], r["problem"]))
    for k in range(14):
        of = lambda rows: [r for r in rows if r["legend_id"] == f"g{k}"]  # noqa: E731, B023
        kept, wrong = sequential(of(entries), of(edits))
        assert by_legend.get(f"g{k}", []) == [shown(e) for e in kept]
        assert bad.get(f"g{k}", []) == wrong
    assert replay_log(spark.createDataFrame([], ENTRY), spark.createDataFrame([], EDIT))[0].count() == 0


def test_a_split_of_merged_drawings(spark):
    e = [{"legend_id": "g", "position": i, "entry_id": f"L{i + 1}", "tag": t, "tag_source": "tag_column", "name": "N", "description": d, "grp": "Other", "counted": i > 0, "confirmed": True, "flags": [], "source": "read", "symbol_boxes": [[10.0 * (3 - i), 0.0, 99.0, 9.0]]}
         for i, (t, d) in enumerate([("A", "RED BOX / BLUE BOX"), ("B", "OTHER")])]
    row = {"legend_id": "g", "tag": None, "name": None, "grp": None, "description": None, "symbol_boxes": None}
    log = [{**row, "seq": 1, "op": "merge", "entry_id": "L2", "value": "L1"}, {**row, "seq": 2, "op": "split", "entry_id": "L1", "value": None}]
    got = replay_log(spark.createDataFrame(e, ENTRY), spark.createDataFrame(log, EDIT))[0].orderBy("position").collect()
    assert [(r["entry_id"], r["tag"], r["name"], r["counted"], r["symbol_boxes"][0][0]) for r in got] == [("L3", "A", "Red box", True, 20.0), ("L4", "BB", "Blue box", True, 30.0)]


@pytest.mark.parametrize("letters", [["AB", "AB", "AB2", "AB", "AB2"], ["B1", "B", "B", "B1", "B"]])
def test_tags_of_mixed_families(spark, letters):
    from markset.operators.legend import assign_tags

    names = [" ".join(c + "x" for c in k) for k in letters]
    rows = [("g", i, n, None, "?") for i, n in enumerate(names)] + [("g", 50, "own", "AB3", "tag_column"), ("g", 51, "own", "B", "tag_column")]
    got = {r["entry_no"]: r["tag"] for r in assign_tags(spark.createDataFrame(rows, "legend_id string, entry_no long, name string, tag string, tag_source string")).collect()}
    taken = {"AB3", "B"}
    for i, k in enumerate(letters):
        want = free(k, taken)
        taken.add(want)
        assert got[i] == want


def test_edits_travel_as_they_were_written(spark, monkeypatch):
    """Names and wordings are costly: they are made behind the shuffle, not by the few tasks that read a small file."""
    from markset.operators import legend_log

    plans, keep = [], legend_log.materialize
    monkeypatch.setattr(legend_log, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]), keep(df, name))[1])
    entries = spark.createDataFrame([("x", 1, "L1", "A", "user", "Old", "duplex outlet (LEFT), wall", "Other", True, False, [], "read", [[0.0, 0.0, 9.0, 9.0]])], ENTRY)
    edits = spark.createDataFrame([("x", 1, "rename", "L1", "New", None, None, None, "wall / floor", None), ("x", 2, "add", None, None, None, None, None, "smoke detector, ceiling", [[20.0, 0.0, 40.0, 9.0]])], EDIT)
    kept, refused = replay_log(entries, edits)
    assert [(r["name"], r["tag"], r["description"]) for r in kept.orderBy("position").collect()] == [("New", "A", "duplex outlet (LEFT), wall"), ("Smoke detector", "SD", "smoke detector, ceiling")]
    assert refused.isEmpty()
    above, below = plans[0].split("Exchange", 1)
    assert "transform(" in above and "transform(" not in below
