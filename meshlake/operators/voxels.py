"""Operators over voxel tables (vid or x, y, z; label, intensity or probabilities)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.runtime import materialize

AXES = ("x", "y", "z")
#: Names that mark a channel as exterior.
EXTERIOR_NAMES = ("background", "air", "bg", "outside", "exterior", "none")


def threshold_label(intensity: Column, thresholds: list[float]) -> Column:
    """How many thresholds the intensity reaches; their order does not matter."""
    return sum(((intensity >= F.lit(float(t))).cast("int") for t in sorted(thresholds)), F.lit(0))


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights for offsets -r .. r, r = max(1, ceil(3 sigma))."""
    r = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(dense: DataFrame, sigma: float, value: str = "intensity") -> DataFrame:
    """Separable smoothing of a dense grid with clamped borders, x then y then z.

    One shuffle an axis: the lines along it are the partitions of a window.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    for axis in AXES:
        line = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        terms = []
        for k, w in enumerate(weights):
            off = k - r
            at = F.col(value) if off == 0 else (F.coalesce(F.lag(value, -off).over(line), first) if off < 0 else F.coalesce(F.lead(value, off).over(line), last))
            terms.append(at * F.lit(w))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        dense = dense.withColumn(value, total)
    return dense


def channel_labels(names: list[str], explicit: list[int] | None = None) -> list[int]:
    """Label of each channel: given, or 0 for exterior names and 1, 2, ... for the others."""
    if explicit is not None:
        if len(explicit) != len(names):
            raise ValueError(f"{len(explicit)} labels for {len(names)} channels")
        return list(explicit)
    out, following = [], 1
    for name in names:
        if name.lower() in EXTERIOR_NAMES:
            out.append(0)
        else:
            out.append(following)
            following += 1
    return out


#: The bin of six (gray, white, fluid, bone, soft, air) of each of 18 head classes, in the order
#: background, gray, white, fluid, ventricles, cerebellum, thalamus, pallidum, putamen, caudate, accumbens,
#: amygdala, hippocampus, dura, vessels, skull, head, anomalies.
SIX_OF_EIGHTEEN = (5, 0, 1, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 3, 4, 3, 4, 0)


def six_class_labels(n_channels: int) -> list[int]:
    """Labels of 18 head channels merged into six classes: air is the exterior, 0, the others 1 to 5."""
    if n_channels != len(SIX_OF_EIGHTEEN):
        raise ValueError(f"the merge into six classes takes 18 channels, not {n_channels}")
    return [0 if k == 5 else k + 1 for k in SIX_OF_EIGHTEEN]


def probability_scale(top: float) -> float:
    """What probabilities are divided by: 1 up to 1.5, 255 up to 255, else their maximum."""
    return 1.0 if top <= 1.5 else 255.0 if top <= 255 else top


def merge_channels(prob: DataFrame, labels: list[int], p: str = "p", scale: float = 1.0) -> DataFrame:
    """p becomes one probability a label, 0 .. max: sums of the non-negative scaled channels. No shuffle."""
    top = max(labels)
    merged = []
    for label in range(top + 1):
        parts = [F.greatest(F.lit(0.0), F.col(p)[c] / F.lit(scale)) for c, own in enumerate(labels) if own == label]
        total = parts[0] if parts else F.lit(0.0)
        for x in parts[1:]:
            total = total + x
        merged.append(total)
    return prob.withColumn(p, F.array(*merged))


def missing_exterior(p: Column, n: int) -> Column:
    """The array with its exterior entry set to what the tissues leave of 1."""
    tissues = p[1]
    for k in range(2, n):
        tissues = tissues + p[k]
    return F.array(F.least(F.greatest(F.lit(1.0) - tissues, F.lit(0.0)), F.lit(1.0)), *[p[k] for k in range(1, n)])


def threshold_bias(p: Column, n: int, thresholds: dict[int, float]) -> Column:
    """Probabilities raised by 0.5 - t for each label that has a threshold."""
    for t in thresholds.values():
        if not 0 < t < 1:
            raise ValueError("thresholds lie between 0 and 1")
    return F.array(*[p[k] + F.lit(0.5 - thresholds[k]) if k in thresholds else p[k] for k in range(n)])


def pair_bias(p: Column, n: int, a: int, b: int, t: float) -> Column:
    """A's probability raised by (0.5 - t) times b's part of what is not a."""
    rest = [p[k] for k in range(n) if k != a]
    total = rest[0]
    for x in rest[1:]:
        total = total + x
    shift = F.when(total > 1e-6, F.lit(0.5 - t) * p[b] / total).otherwise(F.lit(0.0))
    return F.array(*[p[k] + shift if k == a else p[k] for k in range(n)])


def argmax_label(p: Column) -> Column:
    """Index of the greatest entry; of equal ones the lowest."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def soft_volumes(prob: DataFrame, n: int, voxel_volume: float, p: str = "p") -> DataFrame:
    """(label, volume): sums of probability times voxel volume."""
    sums = prob.select(*[F.col(p)[k].alias(f"p{k}") for k in range(n)]).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(n)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (F.col(f"p{k}") * voxel_volume).alias("volume")) for k in range(n)])).alias("r")).select("r.label", "r.volume")


def dilate(points: DataFrame, offsets: list[tuple[int, int, int]], columns: tuple[str, ...] = ()) -> DataFrame:
    """Each point at each offset, with the squared length of the offset in d2."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"d{a}") for o, a in zip(off, AXES, strict=True)], F.lit(sum(o * o for o in off)).alias("d2")) for off in offsets]))
    return points.select(*AXES, *columns, moves.alias("m")).select(*[(F.col(a) + F.col(f"m.d{a}")).alias(a) for a in AXES], "m.d2", *columns)


SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
BALL = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]


def exterior_depth(dense: DataFrame, most: int = 3) -> DataFrame:
    """dense with depth: 6-connected steps to the nearest voxel of label 0, up to most, else null.

    A bounded dilation: no loop, one shuffle.
    """
    ball = [(i, j, k) for i in range(-most, most + 1) for j in range(-most, most + 1) for k in range(-most, most + 1) if abs(i) + abs(j) + abs(k) <= most]
    steps = F.abs("m.dx") + F.abs("m.dy") + F.abs("m.dz")
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz")) for i, j, k in ball]))
    reach = dense.where("label = 0").select(*AXES, moves.alias("m")).select(*[(F.col(a) + F.col(f"m.d{a}")).alias(a) for a in AXES], steps.alias("depth"))
    reach = reach.groupBy(*AXES).agg(F.min("depth").alias("depth"))
    return dense.join(reach, list(AXES), "left")


def without_deep_exterior(prob: DataFrame, dense: DataFrame, n: int, p: str = "p") -> DataFrame:
    """prob with the exterior's probability 0, and the tissues' rescaled to 1, more than two steps inside.

    Steps are 6-connected, from the nearest voxel of label 0 of dense. Voxels without an
    exterior probability stay as they are, and where no tissue has any only the first goes.
    """
    near = exterior_depth(dense, 2).where("depth is not null").select(*AXES, F.lit(True).alias("near"))
    tissues = sum((F.col(p)[k] for k in range(2, n)), F.col(p)[1])
    scaled = F.array(F.lit(0.0), *[F.when(tissues > 0, F.col(p)[k] / tissues).otherwise(F.col(p)[k]) for k in range(1, n)])
    changed = F.when(F.col("near").isNull() & (F.col(p)[0] > 0), scaled).otherwise(F.col(p))
    return prob.join(near, list(AXES), "left").withColumn(p, changed).drop("near")


def shift_fields(p: Column, n: int, bias: dict[int, float]) -> Column:
    """Fields raised by each label's bias, so that a threshold moves the interface."""
    return F.array(*[p[k] + F.lit(float(bias.get(k, 0.0))) for k in range(n)])


def voxel_of(points: DataFrame, dense: DataFrame, value: str, size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """points (pid, px, py, pz) with the value of the voxel whose centre is nearest; null outside. An equality join."""
    at = points.withColumns({a: F.floor(F.col(f"p{a}") / F.lit(float(s)) + 0.5).cast("int") for a, s in zip(AXES, size, strict=True)})
    return at.join(dense.select(*AXES, value), list(AXES), "left").select(*points.columns, value)


def flood(dense: DataFrame, seeds: DataFrame) -> DataFrame:
    """Voxels of dense reachable from seeds over 6-neighbours within dense; both have x, y, z.

    Semi-naive: each round expands only what the last one added, and is written once.
    """
    reached = materialize(seeds.select(*AXES).distinct(), "flood")
    frontier = reached
    while frontier.limit(1).count():
        step = dilate(frontier, SIX).select(*AXES).distinct().join(dense.select(*AXES), list(AXES), "left_semi")
        frontier = materialize(step.join(reached, list(AXES), "left_anti"), "flood")
        reached = materialize(reached.unionByName(frontier), "flood")
    return reached


def fill_holes(dense: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """dense with label 0 voxels that no border voxel reaches given the label of the nearest tissue.

    Nearest in 6-connected steps through the hole; of equally near ones the lowest label
    (the order of a queue, which the sequential form follows, is not a property of data).
    """
    outside = dense.where("label = 0")
    border = F.lit(False)
    for a, n in zip(AXES, size, strict=True):
        border = border | (F.col(a) == 0) | (F.col(a) == n - 1)
    holes = materialize(outside.join(flood(outside, outside.where(border)), list(AXES), "left_anti").select(*AXES), "holes")
    known = dense.where("label <> 0").select(*AXES, "label")
    filled = None
    frontier = known
    while holes.limit(1).count():
        near = dilate(frontier, SIX, ("label",)).groupBy(*AXES).agg(F.min("label").alias("label"))
        frontier = materialize(holes.join(near, list(AXES)), "filled")
        if not frontier.limit(1).count():
            break
        filled = frontier if filled is None else filled.unionByName(frontier)
        holes = materialize(holes.join(frontier, list(AXES), "left_anti"), "holes")
    if filled is None:
        return dense
    new = filled.withColumnRenamed("label", "new")
    return dense.join(new, list(AXES), "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def minimum_gap(dense: DataFrame, a: int, b: int, c: int, d: float, p: str | None = None) -> DataFrame:
    """Voxels of label a with a voxel of label c nearer than d + 1 (in voxels) become b, and their probability in p moves along."""
    reach = math.ceil(d + 1)
    r = range(-reach, reach + 1)
    ball = [(i, j, k) for i in r for j in r for k in r if math.sqrt(i * i + j * j + k * k) < d + 1]
    near = dilate(dense.where(F.col("label") == c), ball).select(*AXES).distinct().withColumn("near", F.lit(True))
    hit = (F.col("label") == a) & F.col("near").isNotNull()
    out = dense.join(near, list(AXES), "left")
    if p is not None:
        # what a had there goes to b
        moved = F.transform(p, lambda v, k: F.when(k == a, F.lit(0.0)).when(k == b, v + F.col(p)[a]).otherwise(v))
        out = out.withColumn(p, F.when(hit, moved).otherwise(F.col(p)))
    return out.withColumn("label", F.when(hit, F.lit(b)).otherwise(F.col("label")).cast("int")).drop("near")


def interface_size(a: Column, b: Column, pair: Column, size_a: Column, size_b: Column, default: float) -> Column:
    """The pair's own size, else the lesser of the labels' sizes, else the one given, else the default."""
    return F.coalesce(pair, F.least(size_a, size_b), F.lit(float(default)))


def gradient_limit(sized: DataFrame, gradient: float, value: str = "h") -> DataFrame:
    """The fixpoint of h <= h(n) + gradient * distance over the 26 neighbours.

    Semi-naive: a round offers the neighbours of voxels that fell in the last one a new
    bound, and only those it lowers go on.
    """
    state = materialize(sized.select(*AXES, value), "gradient")
    changed = state
    while changed.limit(1).count():
        offers = dilate(changed, BALL, (value,)).withColumn("o", F.col(value) + F.lit(gradient) * F.sqrt(F.col("d2").cast("double")))
        offers = offers.groupBy(*AXES).agg(F.min("o").alias("o"))
        # a slack below which a change does not count ends the rounds
        lower = F.col("o") < F.col(value) - 1e-9
        joined = materialize(state.join(offers, list(AXES), "left").select(*AXES, F.when(lower, F.col("o")).otherwise(F.col(value)).alias(value), F.coalesce(lower, F.lit(False)).alias("fell")), "gradient")
        changed, state = joined.where("fell").drop("fell"), joined.drop("fell")
    return state


def brick_labels(dense: DataFrame, radius: int, edge: int = 8) -> DataFrame:
    """(bx, by, bz, labels): sorted labels met in each brick dilated by radius; voxels only count where they exist."""
    spans = [F.sequence(F.floor((F.col(a) - radius) / edge).cast("int"), F.floor((F.col(a) + radius) / edge).cast("int")) for a in AXES]
    out = dense
    for a, s in zip(AXES, spans, strict=True):
        out = out.withColumn(f"b{a}", F.explode(s))
    return out.groupBy("bx", "by", "bz").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def sample_trilinear(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """points (pid, px, py, pz in voxels) with the trilinear value of a dense grid; 8 equi-joined corners a point."""
    base = points.withColumns({f"f{a}": F.floor(F.col(f"p{a}")).cast("int") for a in AXES})
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    near = base.withColumn("c", corners)
    weight = F.lit(1.0)
    for a, c in zip(AXES, "ijk", strict=True):
        t = F.col(f"p{a}") - F.col(f"f{a}")
        weight = weight * F.when(F.col(f"c.{c}") == 1, t).otherwise(F.lit(1.0) - t)
    near = near.select("pid", *[(F.col(f"f{a}") + F.col(f"c.{c}")).alias(a) for a, c in zip(AXES, "ijk", strict=True)], weight.alias("w"))
    return near.join(grid.select(*AXES, value), list(AXES)).groupBy("pid").agg(F.sum(F.col(value) * F.col("w")).alias(value))


def otsu(histogram: DataFrame, level: str = "bin", count: str = "n") -> DataFrame:
    """(threshold): the level that splits a histogram with the greatest variance between the parts.

    The histogram has one row a level, as few as there are levels.
    """
    upto = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    w = F.sum(count).over(upto)
    s = F.sum(F.col(count) * F.col(level)).over(upto)
    rows = histogram.select(level, w.alias("w0"), s.alias("s0"), F.sum(count).over(every).alias("n"), F.sum(F.col(count) * F.col(level)).over(every).alias("s"))
    split = rows.where("w0 < n").withColumn("between", (F.col("s0") * F.col("n") - F.col("s") * F.col("w0")).cast("double") ** 2 / (F.col("w0") * (F.col("n") - F.col("w0"))).cast("double"))
    return split.agg(F.max_by(level, F.struct("between", -F.col(level))).alias("threshold"))
