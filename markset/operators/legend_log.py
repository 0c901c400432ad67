"""Replay of a legend's edit log, edits that create entries included, as one ordered stream."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from markset.functions import text as T
from markset.session import materialize, spread

#: What is written beside one of several drawings of an entry, and flags that a split leaves behind.
SIDE = r"(?i)\((LEFT|RIGHT|TOP|BOTTOM|UPPER|LOWER)\)"
LEFT_BY_SPLIT = ("combined", "wrapped", "duplicate_tag")
#: How a usable tag is written, and the least side of a drawn box.
TAG, LEAST_SIDE = r"[A-Z0-9][A-Z0-9\-./]{0,7}", 4.0

_WORDING = "struct<description:string,name:string,letters:string>"
_STATE = ("entry_id string, tag string, tag_source string, name string, description string, grp string, counted boolean, confirmed boolean, "
          "flags array<string>, source string, symbol_boxes array<array<double>>")
_FIELDS = [c.split()[0] for c in _STATE.split(", ")]


def _worded(description: Column) -> Column:
    """A description without its side, the name made of it and that name's initials."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(description, SIDE, ""), "^[ ,]+", ""), "[ ,]+$", "")
    return T.once(plain, lambda d: T.once(T.nice_name(d), lambda n: F.struct(d.alias("description"), n.alias("name"), T.tag_letters(n).alias("letters")))).cast(_WORDING)


def _wordings(description: Column) -> Column:
    """The whole description, then its parts where it is written ``A / B``."""
    parts = F.filter(F.transform(F.split(description, r"\s+/\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(F.concat(F.array(description), parts), _worded)


class Legend:
    """The entries of one legend between two edits: as many as a sheet shows."""

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}
        self.holders: dict[str, list[str]] = defaultdict(list)
        self.made, self.looked = 0, False

    def put(self, entry: dict, before: str | None = None) -> None:
        if before is None:
            self.entries[entry["entry_id"]] = entry
        else:
            self.entries = dict(itertools.chain.from_iterable(
                [(entry["entry_id"], entry), (k, e)] if k == before else [(k, e)] for k, e in self.entries.items()))
        self.holders[entry["tag"]].append(entry["entry_id"])
        number = entry["entry_id"].removeprefix("L")
        self.made = max(self.made, int(number) if number.isdigit() else 0)

    def drop(self, entry: dict) -> None:
        del self.entries[entry["entry_id"]]
        self.holders[entry["tag"]].remove(entry["entry_id"])

    def check(self, *tags: str) -> None:
        """Flag entries whose tag others have too; a first look is at all tags, later ones at those that changed."""
        for tag in tags if self.looked else list(self.holders):
            crowd = [self.entries[k] for k in self.holders[tag]]
            for e in crowd:
                if len(crowd) > 1 and "duplicate_tag" not in e["flags"]:
                    e["flags"].append("duplicate_tag")
                    e["confirmed"] = False
                elif len(crowd) < 2 and "duplicate_tag" in e["flags"]:
                    e["flags"].remove("duplicate_tag")
        self.looked = True

    def free(self, letters: str, but: str | None = None) -> str:
        """The first of AB, AB2, AB3, ... that no entry but one has."""
        names = itertools.chain([letters], (f"{letters}{n}" for n in itertools.count(2)))
        return next(t for t in names if not set(self.holders[t]) - {but})

    def next_id(self) -> str:
        self.made += 1
        return f"L{self.made}"

    def edit(self, r) -> str | None:
        """Apply one edit; what is wrong with it, if it is refused."""
        if r.op == "add":
            return self.add(r)
        e = self.entries.get(r.entry_id)
        if e is None:
            return "no_such_entry"
        value = (r.value or "").strip()
        if r.op in ("rename", "set_group"):
            if not value:
                return "empty_value"
            e["name" if r.op == "rename" else "grp"] = value
            if r.op == "rename" and "wrapped" in e["flags"]:  # the joined name has been looked at
                e["confirmed"] = True
        elif r.op == "set_tag":
            if not r.tag_ok:
                return "unusable_tag"
            old, new = e["tag"], value.upper()
            self.holders[old].remove(e["entry_id"])
            self.holders[new].append(e["entry_id"])
            e |= {"tag": new, "tag_source": "user", "flags": [f for f in e["flags"] if f != "generated_tag"]}
            self.check(old, new)
        elif r.op == "set_count":
            e["counted"] = value == "true"
        elif r.op == "confirm":
            e["confirmed"] = True
        elif r.op == "delete":
            self.drop(e)
            self.check(e["tag"])
        elif r.op == "merge":
            into = self.entries.get(value)
            if into is None or into is e:
                return "no_such_target"
            into["symbol_boxes"] = into["symbol_boxes"] + e["symbol_boxes"]
            into["counted"] = into["counted"] or e["counted"]
            self.drop(e)
            self.check(e["tag"])
        elif r.op == "split":
            return self.split(e)
        else:
            return "unknown_op"
        return None

    def split(self, e: dict) -> str | None:
        boxes = sorted(e["symbol_boxes"], key=lambda b: b[0])
        if len(boxes) < 2:
            return "one_drawing"
        whole, *parts = e["wordings"]
        words = parts if len(parts) == len(boxes) else [whole] * len(boxes)
        tags = []
        for n, (box, w) in enumerate(zip(boxes, words, strict=True)):
            made = n > 0 or e["tag_source"] == "generated"
            tag = self.free(w["letters"], e["entry_id"]) if made else e["tag"]
            flags = [f for f in e["flags"] if f not in LEFT_BY_SPLIT and f != "generated_tag"] + (["generated_tag"] if made or "generated_tag" in e["flags"] else [])
            new = e | {"entry_id": self.next_id(), "tag": tag, "tag_source": "generated" if made else e["tag_source"], "name": w["name"], "description": w["description"],
                       "symbol_boxes": [box], "flags": flags, "source": "user", "confirmed": True, "wordings": [w]}
            self.put(new, before=e["entry_id"])
            tags.append(tag)
        self.drop(e)
        self.check(e["tag"], *tags)
        return None

    def add(self, r) -> str | None:
        if r.symbol_boxes is None or not len(r.symbol_boxes):
            return "no_box"
        box = [float(v) for v in r.symbol_boxes[0]]
        if box[2] - box[0] < LEAST_SIDE or box[3] - box[1] < LEAST_SIDE:
            return "small_box"
        if r.tag is not None and not r.tag_ok:
            return "unusable_tag"
        made = r.tag is None
        tag = self.free(r.letters) if made else r.tag.strip().upper()
        self.put({"entry_id": self.next_id(), "tag": tag, "tag_source": "generated" if made else "user", "name": r.name, "description": r.description or "", "grp": r.grp, "counted": True,
                  "confirmed": True, "flags": ["generated_tag"] if made else [], "source": "user", "symbol_boxes": [box], "wordings": r.wordings})
        self.check(tag)
        return None


def replay_log(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries after the edits of their legends, in order, and the edits that were refused with the reason.

    ``entries``: legend_id, position and the columns of an entry; ``edits``: legend_id, seq, op, entry_id, value and, for
    ``add``, symbol_boxes (one box), tag, name, grp, description. Ops: rename, set_tag, set_group, set_count, confirm,
    delete, merge (value: the entry that stays), split, add. New entries are numbered after the largest ``L<n>``; those
    of a split take its place, an added one comes last. A partition is a stream sorted by legend, entries first, then
    edits by ``seq``: a task holds the entries of one legend, never its log. Edits of a legend without entries start
    from an empty one. Equal ``seq`` go by op and entry. Names and initials are made beforehand by column expressions.
    """
    # what is read goes through the shuffle; wordings, names and checks are made behind it, for the rows that use them
    base = entries.select("legend_id", F.lit(0).alias("phase"), F.col("position").cast("long").alias("seq"), F.lit("").alias("op"), F.lit(None).cast("string").alias("value"), *_FIELDS)
    log = edits.select("legend_id", F.lit(1).alias("phase"), F.col("seq").cast("long").alias("seq"), "op", "value", "entry_id", "tag", F.lit("user").alias("tag_source"), "name", "description", "grp",
                       F.lit(True).alias("counted"), F.lit(True).alias("confirmed"), F.array().cast("array<string>").alias("flags"), F.lit("user").alias("source"), "symbol_boxes")
    raw = spread(base.unionByName(log).where("legend_id IS NOT NULL"), "legend_id").sortWithinPartitions("legend_id", "phase", "seq", "op", "entry_id")
    entry, adds = F.col("phase") == 0, F.col("op") == "add"
    described = F.when(entry, F.coalesce("description", F.lit(""))).otherwise(F.coalesce(F.trim("description"), F.lit("")))
    named = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.when(described == "", F.lit("New symbol")).otherwise(T.nice_name(described)))
    tag = F.coalesce(F.upper(F.trim(F.when(adds, F.col("tag")).otherwise(F.col("value")))), F.lit(""))
    stream = raw.withColumns({"name": F.when(entry, F.col("name")).when(adds, named), "grp": F.when(entry, F.col("grp")).when(adds, F.coalesce("grp", T.guess_group(described))),
                              "tag_ok": entry | tag.rlike(f"^{TAG}$"), "wordings": F.when(entry | adds, _wordings(described))})
    stream = stream.withColumn("letters", F.when(~entry & adds, T.tag_letters(F.col("name"))))
    kind = entries.schema["legend_id"].dataType.simpleString()
    out = f"legend_id {kind}, seq long, op string, problem string, {_STATE}"

    arrow = to_arrow_schema(StructType.fromDDL(out))

    def state(legend_id, legend: Legend) -> list[dict]:
        return [{"legend_id": legend_id, "seq": n, **{f: e[f] for f in _FIELDS}} for n, e in enumerate(legend.entries.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, legend = None, Legend()
        for b in batches:
            done: list[dict] = []
            for row in b.to_pylist():
                r = SimpleNamespace(**row)
                if current is None or r.legend_id != current:
                    done += state(current, legend)
                    current, legend = r.legend_id, Legend()
                if r.phase == 0:
                    legend.put({f: row[f] for f in _FIELDS} | {"flags": list(r.flags or []), "symbol_boxes": list(r.symbol_boxes or []), "wordings": r.wordings})
                elif problem := legend.edit(r):
                    done.append({"legend_id": current, "seq": r.seq, "op": r.op, "problem": problem, "entry_id": r.entry_id})
            yield pa.RecordBatch.from_pylist(done, arrow)
        yield pa.RecordBatch.from_pylist(state(current, legend), arrow)

    done = materialize(stream.mapInArrow(run, out), "legend-log")
    return (done.where("op IS NULL").withColumnRenamed("seq", "position").select("legend_id", "position", *_FIELDS),
            done.where("op IS NOT NULL").select("legend_id", "seq", "op", "entry_id", "problem"))
