"""K-means for many models at once, and exact silhouettes, over weighted points.

Equal points are one row with a weight. Every step reads the points once for all models: each task
returns sums per model and cluster, a few numbers however many points there are, and the driver
holds nothing but centres. So a search over many cluster counts and starts takes as many jobs as its
slowest model has turns, not a run per model.

Starts are k-means++: the next centre is a point drawn with a chance in proportion to its weight and
squared distance from the centres so far. Each point draws a waiting time from a hash of itself, the
seed and the step, and the shortest one wins, so a draw is one pass and does not depend on how the
points are spread over tasks.

The silhouette compares each point's mean Euclidean distance to its own cluster with that to the
nearest other one, over all points, which is quadratic by definition. Points are dealt into blocks of neighbours; a
task holds a few blocks and streams all others past them, so neither driver nor task holds more, and
the sums for all models come from the same distances. Blocks near each other are compared point by
point. Between blocks far apart the distance is so smooth that interpolation between a few nodes of each gives it
to a billionth at most (``APART``; errors of either sign mostly cancel in the sums), below the eight digits that reports
keep. How the time grows is measured in the README.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tradeweave.plans.grains import rows
from tradeweave.plans.ordering import durable, numbered

CHUNK = 4096  # points that are compared with all centres at once
BLOCK = 1024  # points of a block of the silhouette
GROUPS, TOGETHER = 64, 32  # groups of blocks that are aimed at, and most blocks of a group
STRIP = 64  # points whose distances from a block are held at once
#: nodes an axis, and from where on they do: distance of the middles of two blocks over the sum of their radii
APART = {5: 30.0, 6: 12.0, 8: 4.0, 10: 3.0}
TOLERANCE = 1e-4  # a model is done when none of its centres moves farther
WEIGHT = "weight"


@dataclass
class Model:
    k: int
    seed: int
    centers: np.ndarray  # fewer than k where there are fewer distinct points
    cost: float = 0.0


def weighted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct points and how many rows each stands for."""
    return df.groupBy(*columns).agg(rows().cast("double").alias(WEIGHT))


def _points(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    whole = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    weights = batch.column(WEIGHT).to_numpy(zero_copy_only=False)
    for at in range(0, len(whole), CHUNK):
        yield whole[at : at + CHUNK], weights[at : at + CHUNK]


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of points from centres."""
    return sum((x[:, i, None] - centers[:, i]) ** 2 for i in range(x.shape[1]))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest centre, the first of equal ones, and its squared distance; a centre at a
    time, so that each step runs along the points."""
    columns = np.ascontiguousarray(x.T)
    label, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    squares, part, nearer = np.empty(len(x)), np.empty(len(x)), np.empty(len(x), bool)
    for name, center in enumerate(centers):
        for i, (column, at) in enumerate(zip(columns, center, strict=True)):
            np.subtract(column, at, out=part)
            np.multiply(part, part, out=part if i else squares)
            if i:
                squares += part
        np.less(squares, best, out=nearer)
        np.copyto(label, name, where=nearer)
        np.minimum(best, squares, out=best)
    return label, best


# --- starts


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from the points and the salt (splitmix64)."""
    state = np.full(len(x), salt, np.uint64)
    for i in range(x.shape[1]):
        state = state + (x[:, i] + 0.0).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        state = state ^ (state >> np.uint64(31))
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _drawn(points: DataFrame, columns: Sequence[str], models: dict[int, Model], step: int) -> dict[int, list[float]]:
    """For each model a point drawn by weight and squared distance; none where all are centres."""
    plan = {name: (m.seed, m.centers) for name, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {name: (np.inf, None) for name in plan}
        for batch in batches:
            for x, w in _points(batch, columns):
                x = np.ascontiguousarray(x)
                for name, (seed, centers) in plan.items():
                    share = w * _squares(x, centers).min(axis=1) if len(centers) else w
                    with np.errstate(divide="ignore"):
                        wait = -np.log(_uniform(x, (seed << 20) + step)) / share
                    at = int(wait.argmin())
                    if wait[at] < best[name][0]:
                        best[name] = float(wait[at]), x[at].tolist()
        found = [(name, wait, point) for name, (wait, point) in best.items() if point is not None]
        names, waits, places = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array(waits, pa.float64()), pa.array(places, pa.list_(pa.float64()))],
            names=["model", "wait", "point"],
        )

    found = points.mapInArrow(run, "model int, wait double, point array<double>")
    first = found.groupBy("model").agg(F.min_by("point", F.struct("wait", "point")).alias("point"))
    return {r["model"]: r["point"] for r in first.collect()}


def _started(points: DataFrame, columns: Sequence[str], jobs: Sequence[tuple[int, int]]) -> dict[int, Model]:
    nowhere = np.zeros((0, len(columns)))
    models = {name: Model(k, seed, nowhere) for name, (k, seed) in enumerate(jobs)}
    for step in range(max((k for k, _ in jobs), default=0)):
        waiting = {name: m for name, m in models.items() if m.k > step and len(m.centers) == step}
        for name, point in _drawn(points, columns, waiting, step).items():
            models[name].centers = np.vstack([models[name].centers, point])
    return {name: m for name, m in models.items() if len(m.centers)}


# --- turns


def _sums(points: DataFrame, columns: Sequence[str], models: dict[int, Model]) -> dict[tuple[int, int], tuple]:
    """(model, cluster) to its weight, weighted sums of coordinates and cost, from one scan."""
    plan = {name: m.centers for name, m in models.items()}
    totals = [f"s{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {name: np.zeros((len(c), len(columns) + 2)) for name, c in plan.items()}
        for batch in batches:
            for x, w in _points(batch, columns):
                parts = [w, *(w * x[:, i] for i in range(x.shape[1]))]
                for name, centers in plan.items():
                    label, squares = _nearest(x, centers)
                    found[name] += np.stack([np.bincount(label, p, len(centers)) for p in (*parts, w * squares)], axis=1)
        names = np.concatenate([np.full(len(c), name) for name, c in plan.items()])
        clusters = np.concatenate([np.arange(len(c)) for c in plan.values()])
        values = np.concatenate(list(found.values()))
        columns_of = [pa.array(names, pa.int32()), pa.array(clusters, pa.int32())]
        columns_of += [pa.array(np.ascontiguousarray(v)) for v in values.T]
        yield pa.RecordBatch.from_arrays(columns_of, names=["model", "cluster", WEIGHT, *totals, "cost"])

    kinds = ", ".join(f"{c} double" for c in (WEIGHT, *totals, "cost"))
    found = points.mapInArrow(run, f"model int, cluster int, {kinds}").groupBy("model", "cluster")
    summed = found.agg(*[F.sum(c).alias(c) for c in (WEIGHT, *totals, "cost")])
    return {
        (r["model"], r["cluster"]): (r[WEIGHT], np.array([r[t] for t in totals]), r["cost"]) for r in summed.collect()
    }


def fit_all(
    points: DataFrame, columns: Sequence[str], jobs: Sequence[tuple[int, int]], max_turns: int = 300
) -> list[Model]:
    """A model per (k, seed), by Lloyd's turns, all in the same scans; none where there are no points.

    A cluster that loses all its points keeps its centre.
    """
    models = _started(points, columns, jobs)
    going = dict(models)
    for turn in range(max_turns):
        if not going:
            break
        found = _sums(points, columns, going)
        for name, m in list(going.items()):
            m.cost = sum(found[name, c][2] for c in range(len(m.centers)))
            moved = m.centers.copy()
            for c in range(len(moved)):
                weight, total, _ = found[name, c]
                if weight > 0:
                    moved[c] = total / weight
            still = np.sqrt(((moved - m.centers) ** 2).sum(axis=1).max()) <= TOLERANCE
            if still or turn + 1 == max_turns:
                del going[name]  # the cost is that of these centres
            else:
                m.centers = moved
    return [models[name] for name in sorted(models)]


def assigned(df: DataFrame, columns: Sequence[str], centers: np.ndarray, name: str) -> DataFrame:
    """The rows with the number of the nearest centre, as columns for Spark to work out."""
    squares = F.array(
        *[sum((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, row, strict=True)) for row in centers]
    )
    return df.withColumn(name, (F.array_position(squares, F.array_min(squares)) - 1).cast("int"))


# --- silhouettes


def _cell(columns: Sequence[str], ends: Row) -> Column:
    """The place of a point on a curve through cubes of the space (Morton's), so that neighbours lie together."""
    bits = 60 // len(columns)
    edge = max(ends[f"high_{c}"] - ends[f"low_{c}"] for c in columns) or 1.0
    code = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        cube = F.floor((F.col(c) - F.lit(ends[f"low_{c}"])) / F.lit(edge) * F.lit((1 << bits) - 1))
        for bit in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(cube, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(columns) + i))
    return code


def _far(x: np.ndarray, y: np.ndarray, share: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` the sums of the distances of ``x`` from ``y``, by the columns of ``share``."""
    for at in range(0, len(x), STRIP):
        part = x[at : at + STRIP]
        squares = np.subtract.outer(part[:, 0], y[:, 0])
        squares *= squares
        for i in range(1, x.shape[1]):
            apart = np.subtract.outer(part[:, i], y[:, i])
            apart *= apart
            squares += apart
        out[at : at + STRIP] += np.sqrt(squares, out=squares) @ share


def _axis(values: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on an axis, and by how much each node counts at each value: Chebyshev's, or the values
    themselves where they are no more than ``order``."""
    own, place = np.unique(values, return_inverse=True)
    if len(own) <= order:
        return own, np.eye(len(own))[place]
    low, high = own[0], own[-1]
    angles = (np.arange(order) + 0.5) * np.pi / order
    at = np.clip((values - low) / (high - low) * 2 - 1, -1, 1)
    turns = np.arange(1, order)
    counts = (1 + 2 * np.cos(np.arccos(at)[:, None] * turns) @ np.cos(np.outer(turns, angles))) / order
    return (low + high) / 2 + (high - low) / 2 * np.cos(angles), counts


def _nodes(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid of a block's nodes, and by how much each counts at each point."""
    grid, counts = np.zeros((1, 0)), np.ones((len(x), 1))
    for i in range(x.shape[1]):
        nodes, own = _axis(x[:, i], order)
        grid = np.column_stack([np.repeat(grid, len(nodes), axis=0), np.tile(nodes, len(grid))])
        counts = (counts[:, :, None] * own[:, None, :]).reshape(len(x), -1)
    return grid, counts


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    low, high = x.min(axis=0), x.max(axis=0)
    return (low + high) / 2, float(np.sqrt(((high - low) ** 2).sum()) / 2)


class _Group:
    """Blocks of points whose sums of distances from other blocks are taken together."""

    def __init__(self, blocks: list[np.ndarray], width: int):
        self.blocks = blocks
        balls = [_ball(x) for x in blocks]
        self.middles, self.radii = np.stack([m for m, _ in balls]), np.array([r for _, r in balls])
        self.ends = np.cumsum([len(x) for x in blocks])
        self.points = np.concatenate(blocks)
        self.sums = np.zeros((len(self.points), width))
        self.grids: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # order: nodes, their blocks, sums

    def _grid(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if order not in self.grids:
            grids = [_nodes(x, order)[0] for x in self.blocks]
            block = np.repeat(np.arange(len(grids)), [len(g) for g in grids])
            nodes = np.concatenate(grids)
            self.grids[order] = nodes, block, np.zeros((len(nodes), self.sums.shape[1]))
        return self.grids[order]

    def add(self, y: np.ndarray, share: np.ndarray, spread: np.ndarray | None = None) -> None:
        """Adds the distances from ``y`` by the columns of ``share``, or of ``share @ spread``."""

        def far(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
            found = np.zeros((len(x), share.shape[1]))
            _far(x, y, share, found)
            return found if spread is None else found @ spread

        middle, radius = _ball(y)
        apart = np.sqrt(((self.middles - middle) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.nan_to_num(apart / (self.radii + radius), nan=0.0, posinf=np.inf)
        left = np.ones(len(self.blocks), bool)
        for order, least in APART.items():
            if not (left & (ratio >= least)).any():
                continue
            nodes, block, sums = self._grid(order)
            # a block of hardly more points than nodes is taken as it is
            few = 2 * np.bincount(block, minlength=len(self.blocks)) <= np.diff(self.ends, prepend=0)
            chosen = left & few & (ratio >= least)
            if not chosen.any():
                continue
            grid, counts = _nodes(y, order)
            grid, moments = (grid, counts.T @ share) if 2 * len(grid) <= len(y) else (y, share)
            at = np.flatnonzero(chosen[block])
            sums[at] += far(nodes[at], grid, moments)
            left &= ~chosen
        for k in np.flatnonzero(left):
            self.sums[self.ends[k] - len(self.blocks[k]) : self.ends[k]] += far(self.blocks[k], y, share)

    def whole(self) -> np.ndarray:
        for order, (_, block, sums) in self.grids.items():
            for k, x in enumerate(self.blocks):
                self.sums[self.ends[k] - len(x) : self.ends[k]] += _nodes(x, order)[1] @ sums[block == k]
        return self.sums


def silhouettes(points: DataFrame, columns: Sequence[str], models: Sequence[Model]) -> list[float | None]:
    """The mean silhouette of each model over all points, in Euclidean distance; a point alone in its
    cluster counts 0, and a model of fewer than two clusters that hold points has none."""
    models = list(models)
    if not models:
        return []
    ends = points.agg(rows().alias("n"), *[f(c).alias(f"{e}_{c}") for c in columns for e, f in (("low", F.min), ("high", F.max))]).first()
    if not ends["n"]:
        return [None] * len(models)
    # more points a block the more there are, so that pairs of blocks and points next to each other grow alike
    size = max(BLOCK, int(8 * ends["n"] ** (1 / 3)))
    count = (ends["n"] - 1) // size + 1
    together = min(TOGETHER, max(1, count // GROUPS))
    near = numbered(points.withColumn("cell", _cell(columns, ends)), "cell", *columns)
    placed = durable(near.select(((F.col("position") - 1) / size).cast("long").alias("block"), *columns, WEIGHT))
    found = _sums(points, columns, dict(enumerate(models)))
    sizes = [np.array([found[j, c][0] for c in range(len(m.centers))]) for j, m in enumerate(models)]
    centers = [m.centers for m in models]
    last = np.cumsum([len(c) for c in centers])
    width = int(last[-1])

    def labels(x: np.ndarray) -> list[np.ndarray]:
        return [_nearest(x, c)[0] for c in centers]

    def kinds(x: np.ndarray) -> np.ndarray:
        """A number for each point, the same for points that are in the same clusters of all models."""
        place = np.zeros(len(x), np.int64)
        for label, c in zip(labels(x), centers, strict=True):
            place = np.unique(place * len(c) + label, return_inverse=True)[1]
        return place

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of coordinates, weights and kinds for each stretch of a block; blocks lie in order."""
        for batch in batches:
            if batch.num_rows:
                block = batch.column("block").to_numpy()
                values = np.stack([batch.column(c).to_numpy() for c in (*columns, WEIGHT)], axis=1)
                starts = np.append(0, np.flatnonzero(np.diff(block)) + 1)
                own = [values[a:b] for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True)]
                data = [np.column_stack([v, kinds(v[:, :-1])]).tobytes() for v in own]
                yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(data, pa.binary())], names=["block", "data"])

    stretches = durable(placed.mapInArrow(packed, "block long, data binary"))
    everyone = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((count - 1) // together).cast("long"))).alias("task")
    own = stretches.select(F.call_function("div", "block", F.lit(together)).alias("task"), F.lit(True).alias("own"), "data")
    others = stretches.select(everyone, F.lit(False).alias("own"), "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centers), 2))
        task, mine, group = None, [], None

        def finish() -> None:
            whole = np.concatenate(mine)
            x, w, sums = whole[:, :-2], whole[:, -2], group.whole()
            for j, label in enumerate(labels(x)):
                size, part = sizes[j], sums[:, last[j] - len(sizes[j]) : last[j]]
                held = np.flatnonzero(size > 0)
                totals[j, 1] += w.sum()
                if len(held) < 2:
                    continue
                at = np.arange(len(x))
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside = part[at, label] / (size[label] - 1)
                    means = part / size
                means[:, size == 0] = np.inf
                means[at, label] = np.inf
                outside, larger = means.min(axis=1), np.maximum(inside, means.min(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where((size[label] > 1) & (larger > 0), (outside - inside) / larger, 0.0)
                totals[j, 0] += float((w * score).sum())

        for batch in batches:
            tasks, owns, data = (batch.column(c).to_pylist() for c in ("task", "own", "data"))
            for name, is_own, values in zip(tasks, owns, data, strict=True):
                part = np.frombuffer(values).reshape(-1, len(columns) + 2)
                if name != task:
                    if task is not None:
                        finish()
                    task, mine, group = name, [], None
                if is_own:
                    mine.append(part)
                    continue
                if group is None:
                    group = _Group([np.ascontiguousarray(m[:, :-2]) for m in mine], width)
                y, w = np.ascontiguousarray(part[:, :-2]), part[:, -2]
                # neighbours are mostly of the same few kinds: a column for each of these, not for each cluster
                _, first, place = np.unique(part[:, -1], return_index=True, return_inverse=True)
                share, spread = np.zeros((len(y), len(first))), np.zeros((len(first), width))
                share[np.arange(len(y)), place] = w
                for j, label in enumerate(labels(y[first])):
                    spread[np.arange(len(first)), last[j] - len(centers[j]) + label] = 1
                if 2 * len(first) <= width:
                    group.add(y, share, spread)
                else:
                    group.add(y, share @ spread)
        if task is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(centers)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in totals.T)],
            names=["model", "score", WEIGHT],
        )

    # own rows first; a block is one task's work, and there are as many as the points fill
    dealt = own.unionByName(others).repartition("task").sortWithinPartitions("task", F.col("own").desc())
    scores = dealt.mapInArrow(compare, f"model int, score double, {WEIGHT} double").groupBy("model")
    mean = {r["model"]: r["score"] / r["n"] for r in scores.agg(F.sum("score").alias("score"), F.sum(WEIGHT).alias("n")).collect()}
    return [mean[j] if (sizes[j] > 0).sum() > 1 else None for j in range(len(models))]
