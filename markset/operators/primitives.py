"""Line-work operators: shared blocks, path signatures, poses, scoring, symbol counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markset.functions import geometry as G
from markset.operators.graph import connected_components, greedy_keep
from markset.operators.spatial import _cells, box_join, conflict_test
from markset.session import materialize, spread

TOLERANCE = 0.5 * 200 / 72  # half a point in canonical pixels
CURVE_STEPS = 12
CTRL = ("c0x", "c0y", "c1x", "c1y", "c2x", "c2y", "c3x", "c3y")
POSE_ROWS = [(i, *p) for i, p in enumerate(G.POSES)]
#: Side of the tiles of a page in which poses meet line work.
TILE = 256.0
#: Numbers that a kernel holds at once in one array, about.
HELD = 1 << 19


def _xs(p: str = "") -> list[Column]:
    return [F.col(f"{p}c{i}x") for i in range(4)]


def _ys(p: str = "") -> list[Column]:
    return [F.col(f"{p}c{i}y") for i in range(4)]


def sample_points(step: float) -> Column:
    """Array of points at most about ``step`` apart along a cubic, both ends included."""
    n = F.greatest(F.lit(2), F.ceil(G.control_length(_xs(), _ys()) / step).cast("int") + 1)
    at = lambda i: i / (n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(G.cubic(_xs(), at(i)).alias("x"), G.cubic(_ys(), at(i)).alias("y")))


def explode_samples(df: DataFrame, step: float) -> DataFrame:
    """One row per sample point ``px, py``; the arithmetic stays in generated code."""
    n = F.greatest(F.lit(2), F.ceil(G.control_length(_xs(), _ys()) / step).cast("int") + 1)
    out = df.withColumn("_n", n - 1).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_t", F.col("_i") / F.col("_n"))
    return out.withColumn("px", G.cubic(_xs(), F.col("_t"))).withColumn("py", G.cubic(_ys(), F.col("_t"))).drop("_n", "_i", "_t")


def flat_segments() -> Column:
    """Array of straight pieces of a primitive: one for a line, twelve for a curve."""
    n = F.when(F.col("kind") == 0, 1).otherwise(CURVE_STEPS)
    piece = lambda i: F.struct(G.cubic(_xs(), i / n).alias("ax"), G.cubic(_ys(), i / n).alias("ay"),
                               G.cubic(_xs(), (i + 1) / n).alias("bx"), G.cubic(_ys(), (i + 1) / n).alias("by"))
    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def flat_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda s, g: s + F.sqrt((g["bx"] - g["ax"]) ** 2 + (g["by"] - g["ay"]) ** 2))


def _pose(i: str = "pose") -> list[Column]:
    """The four map entries of pose number ``i`` as columns."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in p[2:]]) for p in G.POSES])
    return [F.element_at(F.element_at(table, F.col(i) + 1), k) for k in (1, 2, 3, 4)]


def _pose_fact(i: str, k: int, cast: str) -> Column:
    return F.element_at(F.array(*[F.lit(p[k]) for p in G.POSES]), F.col(i) + 1).cast(cast)


def exemplar_table(parts: DataFrame, tol: float = TOLERANCE, quantum: float = 0.02) -> DataFrame:
    """One row per exemplar: points, segments, box, length, centre, size and descriptor.

    ``parts``: exemplar_id, part_no, kind and the control points. An exemplar is one
    legend drawing, so what is collected per row is a drawing's own parts.
    """
    p = parts.withColumns({"pts": sample_points(tol), "fine": sample_points(tol / 2), "segs": flat_segments(),
                           "ctrl": F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in zip(_xs(), _ys())])})
    agg = p.groupBy("exemplar_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.flatten(F.collect_list("pts")).alias("pts"), F.flatten(F.collect_list("fine")).alias("fine"),
        F.flatten(F.collect_list("segs")).alias("segs"), F.flatten(F.collect_list("ctrl")).alias("ctrl"),
        F.min(F.least(*_xs())).alias("ex0"), F.min(F.least(*_ys())).alias("ey0"), F.max(F.greatest(*_xs())).alias("ex1"), F.max(F.greatest(*_ys())).alias("ey1"))
    mean = lambda k: F.aggregate("fine", F.lit(0.0), lambda s, v: s + v[k]) / F.size("fine")
    agg = agg.withColumns({"mx": mean("x"), "my": mean("y"), "length": flat_length(F.col("segs"))})
    rms = F.sqrt(F.aggregate("fine", F.lit(0.0), lambda s, v: s + (v["x"] - F.col("mx")) ** 2 + (v["y"] - F.col("my")) ** 2) / F.size("fine"))
    return agg.withColumn("size", F.greatest(rms, F.lit(1e-9))).drop("fine")


def _descriptor(ctrl: Column, mx: Column, my: Column, size: Column, quantum: float, pose: list[Column] | None = None) -> Column:
    """Sorted control points in units of the drawing's size, quantised."""
    def q(v):
        x, y = (v["x"] - mx) / size, (v["y"] - my) / size
        if pose is not None:
            x, y = pose[0] * x + pose[1] * y, pose[2] * x + pose[3] * y
        return F.struct(F.bround(x / quantum).cast("bigint").alias("x"), F.bround(y / quantum).cast("bigint").alias("y"))

    return F.array_sort(F.transform(ctrl, q))


def drawing_components(primitives: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """Component of every primitive: primitives whose boxes lie within ``tol`` belong together."""
    half = tol / 2
    pad = lambda df, n: df.select("page_id", F.col("prim_id").alias(n), (F.col("x0") - half).alias("x0"), (F.col("y0") - half).alias("y0"),
                                  (F.col("x1") + half).alias("x1"), (F.col("y1") + half).alias("y1"))
    pairs = box_join(pad(primitives, "a"), pad(primitives, "b")).where(F.col("a") < F.col("b"))
    node = lambda c: F.struct("page_id", F.col(c).alias("id"))
    comps = connected_components(pairs.select(node("a").alias("src"), node("b").alias("dst")))
    named = comps.select("node.page_id", F.col("node.id").alias("prim_id"), F.col("component.id").alias("comp"))
    return primitives.join(named.hint("merge"), ["page_id", "prim_id"], "left").withColumn("comp", F.coalesce("comp", "prim_id"))


def signature_matches(labelled: DataFrame, exemplars: DataFrame, tol: float = TOLERANCE, scale_tolerance: float = 0.02, quantum: float = 0.02) -> DataFrame:
    """Components drawn like an exemplar in one of the eight poses.

    ``labelled``: primitives with ``comp``. Only components with an exemplar's
    number of parts are gathered. Equal descriptors join by their hash; shapes
    split by rounding are caught by a tolerant two-way distance.
    Returns page_id, comp, exemplar_id, pose, ratio, mx, my.
    """
    sizes = labelled.groupBy("page_id", "comp").agg(F.count(F.lit(1)).alias("n_parts"))
    # exemplars are the legend's drawings: a table of legend size
    fits = sizes.join(exemplars.select("n_parts").distinct(), "n_parts", "left_semi")
    p = labelled.join(fits.hint("merge"), ["page_id", "comp"])
    key = ["page_id", "comp", "n_parts"]
    centre = explode_samples(p, tol / 2).groupBy(*key).agg(
        F.avg("px").alias("mx"), F.avg("py").alias("my"), F.greatest(F.sqrt(F.var_pop("px") + F.var_pop("py")), F.lit(1e-9)).alias("size"))
    ctrl = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in zip(_xs(), _ys())])
    c = p.groupBy(*key).agg(F.flatten(F.collect_list(ctrl)).alias("ctrl")).join(centre.hint("merge"), key)
    desc = F.xxhash64(_descriptor(F.col("ctrl"), F.col("mx"), F.col("my"), F.col("size"), quantum))
    c = materialize(spread(c, "page_id", "comp").withColumn("desc", desc), "drawings")
    e = exemplars.withColumn("pose", F.explode(F.sequence(F.lit(0), F.lit(7))))
    e = e.withColumn("desc", F.xxhash64(_descriptor(F.col("ctrl"), F.col("mx"), F.col("my"), F.col("size"), quantum, _pose())))
    e = e.select("exemplar_id", "n_parts", "pose", "desc", F.col("size").alias("e_size"), F.col("ctrl").alias("e_ctrl"), F.col("mx").alias("emx"), F.col("my").alias("emy"))
    near = F.abs(F.col("size") / F.col("e_size") - 1.0) <= scale_tolerance
    same = c.join(e, ["n_parts", "desc"]).where(near)
    rest = c.join(same.select("page_id", "comp").hint("merge"), ["page_id", "comp"], "left_anti").drop("desc").join(e.drop("desc"), "n_parts").where(near)
    m = _pose()
    turned = F.transform("e_ctrl", lambda v: F.struct(
        (m[0] * (v["x"] - F.col("emx")) / F.col("e_size") + m[1] * (v["y"] - F.col("emy")) / F.col("e_size")).alias("x"),
        (m[2] * (v["x"] - F.col("emx")) / F.col("e_size") + m[3] * (v["y"] - F.col("emy")) / F.col("e_size")).alias("y")))
    mine = F.transform("ctrl", lambda v: F.struct(((v["x"] - F.col("mx")) / F.col("size")).alias("x"), ((v["y"] - F.col("my")) / F.col("size")).alias("y")))
    lim = F.pow(2.0 * tol / F.col("e_size"), F.lit(2.0))
    covered = lambda a, b: F.forall(a, lambda u: F.exists(b, lambda w: (u["x"] - w["x"]) ** 2 + (u["y"] - w["y"]) ** 2 <= lim))
    rest = rest.withColumns({"_t": turned, "_m": mine}).where(covered(F.col("_t"), F.col("_m")) & covered(F.col("_m"), F.col("_t")))
    cols = ["page_id", "comp", "exemplar_id", "pose", (F.col("size") / F.col("e_size")).alias("ratio"), "mx", "my"]
    both = same.select(*cols).unionByName(rest.select(*cols))
    return both.groupBy("page_id", "comp", "exemplar_id").agg(F.min_by(F.struct("pose", "ratio", "mx", "my"), "pose").alias("b")).select("page_id", "comp", "exemplar_id", "b.*")


def signature_poses(matches: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Placement ``x -> A x + b`` of each signature match, as pose, scale and shift."""
    j = matches.join(exemplars.select("exemplar_id", F.col("mx").alias("emx"), F.col("my").alias("emy")), "exemplar_id")
    m = _pose()
    return j.select("page_id", "exemplar_id", "pose", F.col("ratio").alias("scale"),
                    (F.col("mx") - F.col("ratio") * (m[0] * F.col("emx") + m[1] * F.col("emy"))).alias("tx"),
                    (F.col("my") - F.col("ratio") * (m[2] * F.col("emx") + m[3] * F.col("emy"))).alias("ty"), "comp")


def pose_hypotheses(primitives: DataFrame, parts: DataFrame, tol: float = TOLERANCE, max_anchors: int = 2, drawing: str = "exemplar_id") -> DataFrame:
    """Placements that lay an anchor part of an exemplar on a primitive of a page.

    Anchors are the parts whose kind and chord are rarest on the page. Primitives
    meet anchors on chord buckets; all eight poses and both directions are tried
    and placements equal to within the tolerance are merged. Few poses turn one chord
    into the other, so that is asked first; the work goes to all tasks, as it is many
    times the rows read. ``done`` of a primitive, if there, lists the exemplars, by ``drawing``, that are not
    to be searched on it.
    """
    done = [c for c in primitives.columns if c == "done"]
    open_ = ~F.coalesce(F.array_contains("done", F.col(drawing)), F.lit(False)) if done else F.lit(True)
    chord = lambda p: F.sqrt((F.col(f"{p}c3x") - F.col(f"{p}c0x")) ** 2 + (F.col(f"{p}c3y") - F.col(f"{p}c0y")) ** 2)
    size = 4 * tol
    prim = primitives.withColumn("chord", chord("")).withColumn("_b", F.floor(F.col("chord") / size))
    e = parts.select("exemplar_id", "part_no", "kind", *[F.col(c).alias(f"e_{c}") for c in CTRL]).withColumn("e_chord", chord("e_")).where(F.col("e_chord") >= 3 * tol)
    b = F.floor(F.col("e_chord") / size)
    e = e.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    like = F.abs(F.col("chord") - F.col("e_chord")) <= 2 * tol
    counts = (prim.select("page_id", "kind", "_b", "chord", *done).join(e.select("exemplar_id", "part_no", "kind", "_b", "e_chord"), ["kind", "_b"]).where(like & open_)
              .groupBy("page_id", "exemplar_id", "part_no", "kind", F.bround(F.col("e_chord") / tol).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    # parts alike in kind and chord give the same candidates: one of them is enough
    distinct = counts.groupBy("page_id", "exemplar_id", "kind", "bucket").agg(F.min(F.struct("n", "part_no")).alias("m"))
    w = Window.partitionBy("page_id", "exemplar_id").orderBy("m.n", "kind", "bucket", "m.part_no")  # at most one row per part of a drawing
    anchors = (distinct.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_anchors)
               .select("page_id", "exemplar_id", F.col("m.part_no").alias("part_no")).join(e, ["exemplar_id", "part_no"]))
    meet = ["page_id", "kind", "_b"]
    j = spread(prim.select(*meet, "chord", *CTRL, *done), *meet).join(anchors.hint("merge"), meet).where(like & open_)
    turns = [F.struct(F.lit(i).alias("pose"), F.lit(back).alias("back"), *[F.lit(float(v)).alias(f"m{k}") for k, v in enumerate(p[2:])]) for i, p in enumerate(G.POSES) for back in (False, True)]
    j = j.withColumn("_turn", F.explode(F.array(*turns))).select("page_id", "exemplar_id", "_turn.*", *CTRL, *[f"e_{c}" for c in CTRL])
    m = [F.col(f"m{k}") for k in range(4)]
    # points that all lie within twice the tolerance of where they belong have chords no further apart than twice that
    ahead = F.when(F.col("back"), -1.0).otherwise(1.0)
    dx, dy, ex, ey = [F.col(f"{p}c3{v}") - F.col(f"{p}c0{v}") for p in ("", "e_") for v in "xy"]
    off = F.greatest(F.abs(ahead * dx - (m[0] * ex + m[1] * ey)), F.abs(ahead * dy - (m[2] * ex + m[3] * ey)))
    j = j.where(off <= 4 * tol * (1 + 1e-9) + 1e-6)
    qx = [F.when(F.col("back"), F.col(f"c{3 - i}x")).otherwise(F.col(f"c{i}x")) for i in range(4)]
    qy = [F.when(F.col("back"), F.col(f"c{3 - i}y")).otherwise(F.col(f"c{i}y")) for i in range(4)]
    ux = [q - (m[0] * F.col(f"e_c{i}x") + m[1] * F.col(f"e_c{i}y")) for i, q in enumerate(qx)]
    uy = [q - (m[2] * F.col(f"e_c{i}x") + m[3] * F.col(f"e_c{i}y")) for i, q in enumerate(qy)]
    j = j.withColumns({"tx": (ux[0] + ux[1] + ux[2] + ux[3]) / 4, "ty": (uy[0] + uy[1] + uy[2] + uy[3]) / 4})
    resid = F.greatest(*[F.abs(u - F.col("tx")) for u in ux], *[F.abs(u - F.col("ty")) for u in uy])
    ok = j.where(resid <= 2 * tol)
    return (ok.groupBy("page_id", "exemplar_id", "pose", F.bround(F.col("tx") / tol).alias("_kx"), F.bround(F.col("ty") / tol).alias("_ky"))
            .agg(F.min(F.struct("tx", "ty")).alias("t")).select("page_id", "exemplar_id", "pose", F.lit(1.0).alias("scale"), "t.tx", "t.ty"))


def _drawings(exemplars: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """Points and segments of each drawing by the hash of its id; the legend's drawings, which every task needs."""
    rows = exemplars.select(F.xxhash64("exemplar_id").alias("e"), *[F.col(f"{c}.{k}") for c, ks in (("pts", "xy"), ("segs", ("ax", "ay", "bx", "by"))) for k in ks]).collect()
    found = {r[0]: tuple(np.array(v, dtype="float64") for v in r[1:]) for r in rows}
    if len(found) < len(rows):
        raise ValueError("two drawings have one hash")
    return found


def _placed_boxes(poses: DataFrame, exemplars: DataFrame, *more: str) -> DataFrame:
    """The poses with their number ``pose_id``, their drawing's hash ``e`` and their box ``bx0 .. by1``."""
    j = poses.join(exemplars.select("exemplar_id", "ex0", "ey0", "ex1", "ey1", F.size("pts").alias("n_pts"), *more), "exemplar_id")
    m = _pose()
    s, tx, ty = F.col("scale"), F.col("tx"), F.col("ty")
    corner = lambda ex, ey: (s * (m[0] * F.col(ex) + m[1] * F.col(ey)) + tx, s * (m[2] * F.col(ex) + m[3] * F.col(ey)) + ty)
    c = [corner(a, b) for a in ("ex0", "ex1") for b in ("ey0", "ey1")]
    box = [F.least(*[p[0] for p in c]), F.least(*[p[1] for p in c]), F.greatest(*[p[0] for p in c]), F.greatest(*[p[1] for p in c])]
    pose_id = F.xxhash64("page_id", "exemplar_id", "pose", "scale", "tx", "ty")
    return j.select("page_id", "exemplar_id", "pose", "scale", "tx", "ty", "n_pts", *more, pose_id.alias("pose_id"), F.xxhash64("exemplar_id").alias("e"),
                    *[b.alias(n) for b, n in zip(box, ("bx0", "by0", "bx1", "by1"))])


def _contacts(placed: DataFrame, primitives: DataFrame, kernel, reach: float, tol: float) -> DataFrame:
    """What ``kernel`` finds for each pose: ``on``, the number of its points that some primitive reaches, and ``extra``.

    Poses and primitives meet once a tile of the page that both touch, so what travels is a row a tile, and a long
    line stands only in the tiles along it. ``reach``: how far from a primitive a point may be reached. Of a pair the kernel
    gives the points reached as bits, 64 a row, so that meeting in two tiles changes nothing; ``extra`` counts in the
    tile where the primitive starts.
    """
    pad = reach + 1e-6
    near = 2 * tol
    zone = placed.select("page_id", "pose_id", "e", "pose", "scale", "tx", "ty", "bx0", "by0", "bx1", "by1")
    zone = _cells(zone, F.col("bx0") - near, F.col("bx1") + near, F.col("by0") - near, F.col("by1") + near, F.lit(TILE))
    straight = F.coalesce(F.col("kind") == 0, F.lit(False))
    ink = primitives.select("page_id", straight.alias("straight"), *CTRL, F.col("x0").alias("px0"), F.col("y0").alias("py0"), F.col("x1").alias("px1"), F.col("y1").alias("py1"))
    ink = _cells(ink, F.col("px0") - pad, F.col("px1") + pad, F.col("py0") - pad, F.col("py1") + pad, F.lit(TILE))
    # a tile that lies beside all four control points, seen along the chord, holds nothing of the primitive
    ex, ey = F.col("c3x") - F.col("c0x"), F.col("c3y") - F.col("c0y")
    side = lambda x, y: (y - F.col("c0y")) * ex - (x - F.col("c0x")) * ey
    bends = [side(F.col(f"c{i}x"), F.col(f"c{i}y")) for i in (1, 2)]
    at = side((F.col("_gx") + 0.5) * TILE, (F.col("_gy") + 0.5) * TILE)
    half = (TILE / 2 + pad) * (F.abs(ex) + F.abs(ey))
    ink = ink.where((at >= F.least(F.lit(0.0), *bends) - half) & (at <= F.greatest(F.lit(0.0), *bends) + half))
    tile = ["page_id", "_gx", "_gy"]  # the work is many times the bytes read, so it goes to all tasks
    j = spread(zone, *tile).join(spread(ink, *tile).hint("merge"), tile).where(
        (F.col("px0") <= F.col("bx1") + near) & (F.col("px1") >= F.col("bx0") - near) & (F.col("py0") <= F.col("by1") + near) & (F.col("py1") >= F.col("by0") - near))
    inside = (F.col("px0") >= F.col("bx0") - tol) & (F.col("py0") >= F.col("by0") - tol) & (F.col("px1") <= F.col("bx1") + tol) & (F.col("py1") <= F.col("by1") + tol)
    starts = (F.floor(F.col("c0x") / TILE) == F.col("_gx")) & (F.floor(F.col("c0y") / TILE) == F.col("_gy"))
    j = j.select("page_id", "pose_id", "e", "pose", "scale", "tx", "ty", "straight", (inside & starts).alias("inside"), *CTRL)
    pid = primitives.schema["page_id"].dataType.simpleString()
    bits = j.mapInPandas(kernel, f"page_id {pid}, pose_id bigint, word int, bits bigint, extra double")
    words = bits.groupBy("page_id", "pose_id", "word").agg(F.bit_or("bits").alias("bits"), F.sum("extra").alias("extra"))
    return words.groupBy("page_id", "pose_id").agg(F.sum(F.bit_count("bits")).alias("on"), F.sum("extra").alias("extra"))


def _pair_kernel(drawings: dict[int, tuple[np.ndarray, ...]], touch: Callable, alien: Callable | None = None):
    """Runs ``touch`` on pairs of pose and primitive, the pairs of one drawing and kind of primitive at a time, and gives
    the points touched as bits. ``alien`` gives the unexplained length of the primitives inside the box."""
    turns = np.array([p[2:] for p in G.POSES], dtype="float64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = turns[pdf["pose"].to_numpy()] * pdf["scale"].to_numpy()[:, None]
            shift = pdf[["tx", "ty"]].to_numpy()
            ctrl = pdf[list(CTRL)].to_numpy().reshape(-1, 4, 2)
            inside, straight = pdf["inside"].to_numpy(bool), pdf["straight"].to_numpy(bool)
            parts: list[pd.DataFrame] = []
            for (e, _), at in pdf.groupby(["e", "straight"]).indices.items():
                x, y, *segs = drawings[e]
                size = max(1, HELD // max(1, len(x)))
                for rows in (at[i:i + size] for i in range(0, len(at), size)):
                    m, t, c = maps[rows], shift[rows], ctrl[rows]
                    put = lambda u, v: (m[:, :1] * u + m[:, 1:2] * v + t[:, :1], m[:, 2:3] * u + m[:, 3:] * v + t[:, 1:])  # noqa: B023, E731
                    packed = np.packbits(touch(*put(x, y), c, straight[rows[0]]), axis=1, bitorder="little")
                    words = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<i8")
                    extra = np.zeros(len(rows))
                    if alien is not None and (own := np.flatnonzero(inside[rows])).size:
                        ax, ay, bx, by = segs
                        extra[own] = alien(c[own], straight[rows[0]], *[v[own] for pair in (put(ax, ay), put(bx, by)) for v in pair])
                    for k in range(words.shape[1]):
                        got = np.flatnonzero((words[:, k] != 0) | (extra != 0 if k == 0 else False))
                        own = pdf.iloc[rows[got]]
                        parts.append(pd.DataFrame({"page_id": own["page_id"].to_numpy(), "pose_id": own["pose_id"].to_numpy(), "word": np.full(len(got), k, "int32"),
                                                   "bits": words[got, k], "extra": extra[got] if k == 0 else 0.0}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def _bezier(ctrl: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of cubics, a row each, at the parameters ``t``."""
    u = 1.0 - t
    w = np.stack([u**3, 3 * u * u * t, 3 * u * t * t, t**3])
    return ctrl[:, :, 0] @ w, ctrl[:, :, 1] @ w


def _sampled(ctrl: np.ndarray, step: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The points of ``explode_samples`` of some cubics: which cubics, and their points, those with equally many together."""
    length = np.sqrt((np.diff(ctrl, axis=1) ** 2).sum(axis=2)).sum(axis=1)
    n = np.maximum(2, np.ceil(length / step).astype(int) + 1)
    for k in np.unique(n):
        of = np.flatnonzero(n == k)
        for own in np.array_split(of, -(-len(of) * int(k) // HELD)):
            yield own, *_bezier(ctrl[own], np.arange(k) / (k - 1))


def _near_kernel(drawings, tol: float):
    """Points in a cell of twice the tolerance that is next to, or is, one with a sample of the primitive."""
    cell = 2 * tol

    def touch(px, py, ctrl, straight):
        q = [np.floor(v / cell).astype("int64") for v in (px, py)]
        low = [v.min(axis=1, keepdims=True) - 1 for v in q]
        q = [v - a for v, a in zip(q, low, strict=True)]
        wide, high = (int(v.max()) + 2 for v in q)  # a cell more on each side than the points have
        out = np.zeros(px.shape, bool)
        for some, *s in _sampled(ctrl, tol):
            for at in np.array_split(np.arange(len(some)), -(-len(some) * wide * high // HELD)):
                own = some[at]
                i, j = (np.floor(v[at] / cell).astype("int64") - a[own] for v, a in zip(s, low, strict=True))
                row, k = np.nonzero((i >= 0) & (i < wide) & (j >= 0) & (j < high))
                ink = np.zeros((len(own), wide, high), bool)
                ink[row, i[row, k], j[row, k]] = True
                broad = ink.copy()
                broad[:, 1:] |= ink[:, :-1]
                broad[:, :-1] |= ink[:, 1:]
                near = broad.copy()
                near[:, :, 1:] |= broad[:, :, :-1]
                near[:, :, :-1] |= broad[:, :, 1:]
                out[own] = near[np.arange(len(own))[:, None], q[0][own], q[1][own]]
        return out

    return _pair_kernel(drawings, touch)


def coarse_filter(poses: DataFrame, primitives: DataFrame, exemplars: DataFrame, threshold: float = 0.9, tol: float = TOLERANCE) -> DataFrame:
    """Drop poses whose sample points mostly lie away from ink.

    Ink is marked on cells of twice the tolerance, with the cells around, so the
    share of marked points is never below the exact coverage.
    """
    placed = materialize(_placed_boxes(poses, exemplars), "hypotheses")
    hit = _contacts(placed, primitives, _near_kernel(_drawings(exemplars), tol), 4 * tol, tol).select("page_id", "pose_id", "on")
    same = (placed["page_id"] == hit["page_id"]) & (placed["pose_id"] == hit["pose_id"])
    return placed.join(hit.hint("merge"), same & (hit["on"] >= threshold * placed["n_pts"]), "left_semi").select("page_id", "exemplar_id", "pose", "scale", "tx", "ty")


def _gaps(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Distance of the points of each row to the nearest of the row's segments."""
    best = np.full(px.shape, np.inf)
    for k in range(ax.shape[1]):
        cut = slice(k, k + 1)
        ex, ey = bx[:, cut] - ax[:, cut], by[:, cut] - ay[:, cut]
        inv = 1.0 / np.maximum(ex * ex + ey * ey, 1e-12)
        dx, dy = px - ax[:, cut], py - ay[:, cut]
        t = np.clip((dx * ex + dy * ey) * inv, 0.0, 1.0)
        np.minimum(best, (dx - t * ex) ** 2 + (dy - t * ey) ** 2, out=best)
    return np.sqrt(best)


def _contact_kernel(drawings, tol: float, share: float):
    """Points that lie on the primitive, and its length if it is inside the box but not explained by the drawing."""

    def pieces(ctrl, straight):
        return _bezier(ctrl, np.linspace(0.0, 1.0, (1 if straight else CURVE_STEPS) + 1))

    def touch(px, py, ctrl, straight):
        lx, ly = pieces(ctrl, straight)
        return _gaps(px, py, lx[:, :-1], ly[:, :-1], lx[:, 1:], ly[:, 1:]) <= tol

    def alien(ctrl, straight, ax, ay, bx, by):
        lx, ly = pieces(ctrl, straight)
        out = np.hypot(np.diff(lx, axis=1), np.diff(ly, axis=1)).sum(axis=1)
        for own, sx, sy in _sampled(ctrl, tol / 2):
            out[own[(_gaps(sx, sy, ax[own], ay[own], bx[own], by[own]) <= tol).mean(axis=1) >= share]] = 0.0
        return out

    return _pair_kernel(drawings, touch, alien)


def score_poses(poses: DataFrame, primitives: DataFrame, exemplars: DataFrame, threshold: float = 0.9, tol: float = TOLERANCE,
                extra_match_fraction: float = 0.8) -> DataFrame:
    """Coverage times precision of every pose that reaches the threshold, with its box.

    Coverage is the share of exemplar points within ``tol`` of ink; precision the
    exemplar's length over that plus the unexplained ink wholly inside the box.
    Primitives meet poses by tiles; both shares come from that join.
    """
    j = materialize(_placed_boxes(poses, exemplars, "length"), "placed")
    seen = _contacts(j, primitives, _contact_kernel(_drawings(exemplars), tol, extra_match_fraction), tol, tol).where("on > 0")
    out = j.join(seen.hint("merge"), ["page_id", "pose_id"]).withColumn("coverage", F.col("on") / F.col("n_pts"))
    score = F.col("coverage") * F.col("length") / (F.col("length") + F.col("extra"))
    return out.withColumn("score", score).where(F.col("score") >= threshold).select(
        "page_id", "exemplar_id", "pose", _pose_fact("pose", 0, "int").alias("rotation"), _pose_fact("pose", 1, "boolean").alias("mirrored"), "scale", "tx", "ty", "coverage", "score",
        F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))


def match_paths(primitives: DataFrame, parts: DataFrame, threshold: float = 0.9, tol: float = TOLERANCE, drawing: str = "exemplar_id") -> DataFrame:
    """Every place where an exemplar is drawn on a page, best detection per spot.

    Whole components first; a component that is an exemplar leaves the search for that one,
    not for others, which may be a part of it. The remaining primitives are tried as anchors.
    ``drawing`` is what exemplars that are one drawing, at several sizes, have in common.
    """
    prim = materialize(drawing_components(primitives, tol), "primitives")
    ex = materialize(exemplar_table(parts, tol), "exemplars")
    found = materialize(signature_poses(signature_matches(prim, ex, tol), ex), "signatures")
    first = materialize(score_poses(found.drop("comp"), prim, ex, threshold, tol), "scored")
    used = found.join(first.select("page_id", "exemplar_id", "pose", "tx", "ty").hint("merge"), ["page_id", "exemplar_id", "pose", "tx", "ty"], "left_semi").groupBy("page_id", "comp").agg(F.collect_set(F.col(drawing)).alias("done"))
    left = prim.join(used.hint("merge"), ["page_id", "comp"], "left")
    tried = materialize(coarse_filter(pose_hypotheses(left, parts, tol, drawing=drawing), prim, ex, threshold, tol), "poses")
    hits = first.unionByName(score_poses(tried, prim, ex, threshold, tol))
    key = F.xxhash64("page_id", "exemplar_id", "pose", "tx", "ty")
    hits = materialize(hits.withColumn("box_id", key), "hits")
    order = [(-F.bround("score", 3)).alias("o1"), F.col("mirrored").cast("int").alias("o2"), F.col("rotation").alias("o3"), F.col("y0").alias("o4"), F.col("x0").alias("o5")]
    kept = greedy_keep(hits, order, conflict_test(None, 0.5), page=("page_id", "exemplar_id")).where("kept")
    return hits.join(kept.select("page_id", "exemplar_id", "box_id").hint("merge"), ["page_id", "exemplar_id", "box_id"])


def exemplar_placement(placements: DataFrame, boxes: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Placement that best fits each exemplar box: highest IoU, then deepest nesting."""
    p = placements.select("page_id", "placement_id", "group_key", "depth", "x0", "y0", "x1", "y1")
    j = box_join(boxes.select("page_id", "exemplar_id", "x0", "y0", "x1", "y1"), p)
    score = F.round(G.iou(G.box_cols(), G.box_cols("r")), 6)
    best = j.withColumn("iou", score).where(F.col("iou") >= min_iou).groupBy("page_id", "exemplar_id").agg(
        F.max_by(F.struct("placement_id", "group_key", "iou"), F.struct("iou", "depth", (-F.col("placement_id")).alias("n"))).alias("b"))
    return best.select("page_id", "exemplar_id", "b.*")


def placements_of_group(placements: DataFrame, refs: DataFrame, rotations: tuple[int, ...] = (0, 90, 180, 270), allow_mirrored: bool = True,
                        angle_tolerance: float = 1.0) -> DataFrame:
    """Every placement of a reference's block, turned and scaled relative to it.

    ``refs``: group_key, exemplar_id, r11, r12, r21, r22. ``angle`` is null for quarter turns.
    """
    det = F.col("r11") * F.col("r22") - F.col("r12") * F.col("r21")
    j = placements.join(refs.where(F.abs(det) > 1e-12), "group_key")
    i11, i12, i21, i22 = F.col("r22") / det, -F.col("r12") / det, -F.col("r21") / det, F.col("r11") / det
    a = [F.col("m11") * i11 + F.col("m12") * i21, F.col("m11") * i12 + F.col("m12") * i22, F.col("m21") * i11 + F.col("m22") * i21, F.col("m21") * i12 + F.col("m22") * i22]
    j = j.withColumns(dict(zip(("q11", "q12", "q21", "q22"), a)))
    angle, mirrored, scale = G.decompose(*[F.col(c) for c in ("q11", "q12", "q21", "q22")])
    j = j.withColumns({"_angle": angle, "mirrored": mirrored, "scale": scale})
    rot, dev = G.snap_quarter(F.col("_angle"))
    j = j.withColumns({"rotation": rot, "_dev": dev})
    keep = F.col("rotation").isin(*rotations) & (F.lit(allow_mirrored) | ~F.col("mirrored"))
    return j.where(keep).withColumn("angle", F.when(F.col("_dev") > angle_tolerance, F.col("_angle"))).drop("_angle", "_dev", "q11", "q12", "q21", "q22")


def ink_cells(primitives: DataFrame, boxes: DataFrame, grid: int = 16) -> DataFrame:
    """Inked cells of a 16 x 16 grid over each box, keeping its aspect.

    ``boxes``: page_id, box_id, x0..y1; primitives belong to a box by their centre.
    """
    from markset.operators.spatial import range_join

    near = range_join(boxes, primitives, center_only=True)
    p = explode_samples(near.select("page_id", "box_id", "x0", "y0", "x1", "y1", *CTRL), 1.0)
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    s = F.greatest(w, h)
    cell = lambda v, lo, ext: F.least(F.greatest(((v - (lo - (s - ext) / 2)) / s * grid).cast("int"), F.lit(0)), F.lit(grid - 1))
    return p.select("page_id", "box_id", cell(F.col("py"), F.col("y0"), h).alias("row"), cell(F.col("px"), F.col("x0"), w).alias("col")).distinct()


def resolve_spots(cands: DataFrame, has_text: DataFrame | None = None, same_spot: float = 0.5, margin: float = 0.05, raster_margin: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """One symbol per spot: the kept candidates and the number dropped per page and tag.

    ``cands``: page_id, box_id, tag, legend_order, needs_label, label, detail, source,
    score, x0..y1. On pages with text a symbol that needs a label must have one. A
    candidate joins the strongest leader in reach; among those close to the best
    score a label wins, then detail, then score, then legend order.
    """
    texted = cands if has_text is None else cands.join(has_text.select("page_id").distinct().withColumn("_text", F.lit(True)), "page_id", "left")
    on_page = F.lit(False) if has_text is None else F.coalesce("_text", F.lit(False))
    gate = ~(F.col("needs_label") & on_page & F.col("label").isNull())
    flagged = materialize(texted.withColumn("_ok", gate), "candidates")  # read by the walk, the choice and the counts
    ok = flagged.where("_ok")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hw, hh = F.greatest((F.col("x1") - F.col("x0")) / 2, F.lit(0.5)), F.greatest((F.col("y1") - F.col("y0")) / 2, F.lit(0.5))
    reach = ok.select("page_id", "box_id", F.col("y0").alias("oy"), F.col("x0").alias("ox"), "score", (cx - hw).alias("x0"), (cy - hh).alias("y0"), (cx + hw).alias("x1"), (cy + hh).alias("y1"))

    def near(a, b):
        dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
        short = F.least(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1])
        return F.sqrt(dx * dx + dy * dy) < F.greatest(same_spot * short, F.lit(1.0))

    spots = greedy_keep(reach, [(-F.col("score")).alias("o1"), F.col("oy").alias("o2"), F.col("ox").alias("o3")], near, leaders="number")
    lean = ok.select("page_id", "box_id", "score", (F.col("source") == "raster").alias("raster"), F.col("label").isNotNull().cast("int").alias("labelled"), "detail", "legend_order")
    g = lean.join(spots.select("page_id", "box_id", "leader").hint("merge"), ["page_id", "box_id"])
    spot = Window.partitionBy("page_id", "leader")  # travels once for the best score and for the choice
    g = g.withColumns({"best": F.max("score").over(spot), "raster": F.max("raster").over(spot)})
    close = F.col("score") >= F.col("best") - F.when(F.col("raster"), raster_margin).otherwise(margin)
    key = F.struct(F.col("labelled").alias("a"), (F.bround(F.coalesce("detail", F.lit(0.0)) * 50) / 50).alias("b"), F.bround("score", 2).alias("c"),
                   (-F.col("legend_order")).alias("d"), (-F.col("box_id")).alias("e"))
    win = g.where(close).groupBy("page_id", "leader").agg(F.max_by("box_id", key).alias("box_id"))
    win = materialize(win.select("page_id", "box_id"), "winners").hint("merge")
    kept = ok.join(win, ["page_id", "box_id"], "left_semi")
    dropped = flagged.join(win, ["page_id", "box_id"], "left_anti").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("dropped"))
    return kept.drop("_ok", "_text"), dropped


def symbol_counts(found: DataFrame, tags: DataFrame) -> DataFrame:
    """Symbols per sheet and tag with an ``all`` row per tag; counted tags that were not
    found appear with 0 in the total."""
    n = found.groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("n"))
    by_sheet = n.select(F.col("page_id").cast("string").alias("sheet"), "tag", "n")
    total = tags.select("tag").distinct().join(n.groupBy("tag").agg(F.sum("n").alias("n")), "tag", "left").select(F.lit("all").alias("sheet"), "tag", F.coalesce("n", F.lit(0)).alias("n"))
    return by_sheet.unionByName(total)


def choose_scale(tally: DataFrame, sample_pages: int = 3) -> DataFrame:
    """Size at which a symbol is drawn on the sheets.

    ``tally``: symbol, page_no, factor, n. Matches are added up over pages until the
    symbol has turned up on ``sample_pages`` of them; the factor with most matches
    wins, ties go to the one nearest 1.
    """
    hits = tally.groupBy("symbol", "page_no").agg((F.sum("n") > 0).alias("hit")).where("hit")
    w = Window.partitionBy("symbol").orderBy("page_no")
    last = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample_pages).groupBy("symbol").agg(F.max("page_no").alias("last"), F.count(F.lit(1)).alias("k"))
    used = tally.join(last, "symbol").where((F.col("k") < sample_pages) | (F.col("page_no") <= F.col("last")))
    sums = used.groupBy("symbol", "factor").agg(F.sum("n").alias("n"))
    best = F.max_by(F.struct("factor", "n"), F.struct("n", (-F.round(F.abs(F.log("factor")), 12)).alias("d"), F.col("factor")))
    return sums.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*").where(F.col("n") > 0)


def learned_effect(judged: DataFrame) -> DataFrame:
    """Per tag: look-alikes thrown out and matches added by learned variants."""
    return judged.groupBy("tag").agg(F.count_if((F.col("source") != "learned") & ~F.col("accept")).alias("rejected"), F.count_if((F.col("source") == "learned") & F.col("accept")).alias("added"))


def scan_set(primitives: DataFrame, parts: DataFrame, legend: DataFrame, lines: DataFrame | None = None, threshold: float = 0.9, tol: float = TOLERANCE) -> dict[str, DataFrame]:
    """Count the legend's symbols on every sheet of a set.

    ``legend``: exemplar_id, tag, legend_order, needs_label, detail, and ``label`` for
    symbols told apart by text. Returns detections, dropped and counts.
    """
    from markset.operators.text import label_near

    found = match_paths(primitives, parts, threshold, tol).join(legend.drop("label"), "exemplar_id").withColumn("source", F.lit("vector"))
    if lines is None:
        found = found.withColumn("label", F.lit(None).cast("string"))
    else:
        found = label_near(found.withColumn("label_set", F.col("exemplar_id")), lines, legend.where(F.col("label").isNotNull()).select(F.col("exemplar_id").alias("label_set"), "label"))
    found = materialize(found, "found")
    kept, dropped = resolve_spots(found, lines)
    kept = materialize(kept, "kept")
    return {"detections": kept, "dropped": dropped, "counts": symbol_counts(kept, legend)}
