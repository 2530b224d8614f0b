"""Leaf-wise gradient boosting on histograms.

Features become bins at the percentiles of all rows. A tree grows by its leaf of the largest gain,
read from sums of gradients and rows by (feature, bin), up to `leaves` leaves. Few rows are
learned from by one task a model. More are dealt over tasks that run at the same time (a barrier
stage), each with its own rows in memory; what they exchange are sums, through files in the shared
folder, as the exchange that Spark gives to barrier tasks takes a second. All models grow in the
same tasks. To exchange seldom, all leaves that may yet be split are, and the order of gains then
tells which of them the tree has: about as many exchanges as it is deep. Scoring is a map over all rows.

A row's leaf of every tree is found without walking: a bit for each leaf, from left to right, and
for each bin of a feature the leaves that its cuts leave over. What all features leave over has
the row's leaf as its lowest bit.
"""

from __future__ import annotations

import heapq
import math
import time
import uuid
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, stored

#: Rows that are predicted at once, rows that one task learns from alone, and rows for each cell from which features are summed together.
ROWS, ALONE, JOINT = 512, 200_000, 4


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    bins: int = 255
    least_rows: int = 20


@dataclass
class Tree:
    """Nodes in order of making; a node without children is a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, x in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def predict(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            node = at[rows]
            rows = rows[feature[node] >= 0]
            node = at[rows]
            at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])
        return np.array(self.value)[at]


@dataclass
class Model:
    """Features with their bin edges, the base value, and trees."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    @cached_property
    def _masks(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        """For each feature the leaves left over by (bin, tree), and the leaves' values by tree; None where a tree has more than 64 leaves."""
        most = max((tree.feature.count(-1) for tree in self.trees), default=0)
        if not 0 < most <= 64:
            return None
        kind = np.dtype(np.uint32 if most <= 32 else np.uint64)
        masks = [np.full((len(e) + 1, len(self.trees)), np.iinfo(kind).max, kind) for e in self.edges]
        values = np.zeros((len(self.trees), 8 * kind.itemsize))

        def leaves(t: int, tree: Tree, node: int, first: int) -> int:
            """The number of leaves under a node; `first` is that of its first one."""
            if tree.feature[node] < 0:
                values[t, first] = tree.value[node]
                return 1
            n = leaves(t, tree, tree.left[node], first)
            masks[tree.feature[node]][tree.bin[node] + 1 :, t] &= kind.type(np.iinfo(kind).max ^ (((1 << n) - 1) << first))
            return n + leaves(t, tree, tree.right[node], first + n)

        for t, tree in enumerate(self.trees):
            leaves(t, tree, 0, 0)
        return masks, values

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The base and the trees' values, added in the order of the trees."""
        bins = binned(x, self.edges)
        out = np.full(len(x), self.base)
        if self._masks is None:
            for tree in self.trees:
                out += tree.predict(bins)
            return out
        (masks, values), columns = self._masks, np.ascontiguousarray(bins.T)
        flat, at = values.ravel(), np.arange(len(values)) * values.shape[1]
        size = (min(ROWS, len(x)), len(values))
        left, one = np.empty((2, *size), masks[0].dtype)
        leaf, value = np.empty(size, np.intp), np.empty(size)
        for lo in range(0, len(x), ROWS):
            n = min(ROWS, len(x) - lo)
            a, b, c, v = left[:n], one[:n], leaf[:n], value[:n]
            np.take(masks[0], columns[0, lo : lo + n], 0, a, "clip")
            for mask, column in zip(masks[1:], columns[1:], strict=True):
                np.take(mask, column[lo : lo + n], 0, b, "clip")
                a &= b
            # the number of bits below the lowest one
            np.negative(a, b)
            a &= b
            a -= a.dtype.type(1)
            np.bitwise_count(a, out=c, casting="unsafe")
            c += at
            np.take(flat, c, None, v, "clip")
            v[:, 0] += self.base
            np.cumsum(v, 1, out=v)
            out[lo : lo + n] = v[:, -1]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value of each column: the number of edges below it; missing values stand in the last bin."""
    out = np.empty(x.shape, np.int32)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f], "left")
        out[np.isnan(x[:, f]), f] = len(e)
    return out


@dataclass
class _Node:
    """A leaf's best split (gain, feature, last bin on the left), its rows here, sums over all rows, and its children once they are known."""

    split: tuple[float, int, int]
    rows: np.ndarray
    sums: np.ndarray
    kids: tuple[_Node, _Node] | None = None

    def here(self) -> np.ndarray:
        return self.rows if self.kids is None else np.sort(np.concatenate([k.here() for k in self.kids]))


def _packed(sizes: list[int], cells: int = 1 << 15) -> list[tuple[list[int], list[int]]]:
    """Features, and their numbers of bins, in groups that have no more cells together: the largest first, each with the largest that still go with it."""
    left, out = sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)), []
    while left:
        group = [left.pop(0)]
        for f in list(left):
            if math.prod(sizes[g] for g in group) * sizes[f] <= cells:
                group.append(f)
                left.remove(f)
        out.append((group, [sizes[f] for f in group]))
    return out


def _step(n: int, largest: float) -> float:
    """The power of two whose multiples gradients are, so that sums of n of them are exact in any order; largest is that of the labels.

    So equal splits have equal gains, and trees do not hang on how rows are dealt. Of 36 million rows with labels up to 8, a step is 5e-7.
    """
    bits = lambda x: math.ceil(math.log2(max(x, 2.0**-500)))
    return 2.0 ** (bits(n) + bits(4 * largest) - 52)


def _rounded(x: np.ndarray, step: float) -> np.ndarray:
    return np.rint(x / step) * step


class _Grower:
    """Grows trees over bins and labels: all rows, or one task's share of them (shared is the mean of all labels, and the step, then)."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, settings: Settings, shared: tuple[float, float] | None = None):
        self.s, self.label, self.shared = settings, label, shared is not None
        self.shape = (bins.shape[1], settings.bins + 1)
        self.columns = np.ascontiguousarray(bins.T, np.uint8 if settings.bins < 256 else np.int32)
        self.joint = [(fs, sizes, self._joined(fs, sizes)) for fs, sizes in _packed([int(c.max(initial=0)) + 1 for c in self.columns])]
        if shared is None:
            step = _step(len(label), float(np.abs(label).max(initial=0.0)))
            shared = float(_rounded(label, step).mean()) if len(label) else 0.0, step
        self.base, self.step = shared
        self.prediction = np.full(len(label), self.base)

    def _joined(self, fs: list[int], sizes: list[int]) -> np.ndarray:
        """Bins of several features as one number."""
        if len(fs) == 1:
            return self.columns[fs[0]]
        out = np.zeros(len(self.label), np.uint16)
        for f, size in zip(fs, sizes, strict=True):
            out = out * np.uint16(size) + self.columns[f]
        return out

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        """Gradients and rows by feature and bin. Where there are many more rows than cells, those of several features come from one pass over their cells."""
        out, every = np.zeros((2, *self.shape)), len(rows) == len(self.label)
        at = rows.astype(np.intp)
        gradient = self.gradient if every else self.gradient.take(at)

        for fs, sizes, column in self.joint:
            n = math.prod(sizes)
            if len(fs) > 1 and len(rows) >= JOINT * n:
                column = column.astype(np.intp) if every else column.take(at).astype(np.intp)
                cells = [np.bincount(column, w, n).reshape(sizes) for w in (gradient, None)]
                for i, (f, size) in enumerate(zip(fs, sizes, strict=True)):
                    others = tuple(k for k in range(len(fs)) if k != i)
                    out[0, f, :size], out[1, f, :size] = cells[0].sum(others), cells[1].sum(others)
                continue
            for f in fs:
                column = self.columns[f] if every else self.columns[f].take(at)
                column = column.astype(np.intp)
                out[0, f] = np.bincount(column, gradient, self.shape[1])
                out[1, f] = np.bincount(column, minlength=self.shape[1])
        return out

    def _best(self, sums: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin on the left) of a leaf's best split; of equal ones the first."""
        g, n = np.cumsum(sums, axis=2)
        all_g, all_n = g[:, -1:], n[:, -1:]
        rest = all_n - n
        ok = (n >= self.s.least_rows) & (rest >= self.s.least_rows)
        gain = np.where(ok, g**2 / np.maximum(n, 1) + (all_g - g) ** 2 / np.maximum(rest, 1) - all_g**2 / np.maximum(all_n, 1), 0.0)
        f, b = divmod(int(np.argmax(gain)), self.shape[1])
        return float(gain[f, b]), f, b

    def _plan(self, root: _Node) -> tuple[Tree, dict[int, _Node], list[_Node]]:
        """The tree as far as splits are known, the leaf of the largest gain first; its leaves; and the leaves that must be split to go on.

        Alone, that is the next one; with other tasks, all that are next if no child of theirs comes before.
        """
        tree = Tree()
        leaves, wanted = {tree.add(): root}, []
        order = [(-root.split[0], 0)]
        while order and len(leaves) + len(wanted) < self.s.leaves and (self.shared or not wanted):
            gain, at = heapq.heappop(order)
            if -gain <= 1e-12:
                break
            node = leaves[at]
            if node.kids is None:
                wanted.append(node)
                continue
            del leaves[at]
            _, tree.feature[at], tree.bin[at] = node.split
            tree.left[at], tree.right[at] = tree.add(), tree.add()
            for child, kid in zip((tree.left[at], tree.right[at]), node.kids, strict=True):
                leaves[child] = kid
                heapq.heappush(order, (-kid.split[0], child))
        return tree, leaves, wanted

    def growing(self) -> Generator[np.ndarray, np.ndarray, Tree]:
        """Grows the next tree: gives sums over the rows here, and is sent the same over all rows. Of two children the smaller one is summed, the other is the difference."""
        self.gradient = _rounded(self.prediction - self.label, self.step)
        everything = np.arange(len(self.label), dtype=np.int32)
        sums = yield self._sums(everything)
        root = _Node(self._best(sums), everything, sums)
        while True:
            tree, leaves, wanted = self._plan(root)
            if not wanted:
                break
            halves, found = [], []
            for node in wanted:
                _, f, b = node.split
                below = self.columns[f].take(node.rows) <= b
                parts = node.rows.compress(below), node.rows.compress(~below)
                n = node.sums[1, f]
                small = int(n[b + 1 :].sum() < n[: b + 1].sum())
                halves.append((parts, small))
                found.append(self._sums(parts[small]))
            found = yield np.stack(found)
            for node, (parts, small), mine in zip(wanted, halves, found, strict=True):
                both = [node.sums - mine, node.sums - mine]
                both[small] = mine
                both[1 - small][1] = np.rint(both[1 - small][1])
                node.kids = tuple(_Node(self._best(x), rows, x) for rows, x in zip(parts, both, strict=True))
                node.rows = node.sums = None
        mine = {at: node.here() for at, node in leaves.items()}
        totals = yield np.array([(self.gradient[rows].sum(), len(rows)) for rows in mine.values()])
        for (at, rows), (total, n) in zip(mine.items(), totals, strict=True):
            if n:
                tree.value[at] = float(-self.s.rate * (total / n))
                self.prediction[rows] += tree.value[at]
        return tree

    def tree(self) -> Tree:
        """The next tree of all rows."""
        return _together({"": self}, 1, lambda x: x)[""][0]


def _together(growers: dict[str, _Grower], rounds: int, total: Callable[[np.ndarray], np.ndarray]) -> dict[str, list[Tree]]:
    """So many trees of each grower; what all of them wait for goes through one call of total, which sums an array over all tasks."""
    trees, live = {name: [] for name in growers}, {}

    def go_on(name: str, sent: np.ndarray | None = None) -> None:
        """To the grower's next wait."""
        steps = live[name][0] if name in live else growers[name].growing()
        try:
            live[name] = steps, steps.send(sent)
        except StopIteration as end:
            trees[name].append(end.value)
            del live[name]
            if len(trees[name]) < rounds:
                go_on(name)

    for name in growers if rounds else ():
        go_on(name)
    while live:
        asked = {name: x for name, (_, x) in live.items()}
        found = total(np.concatenate([x.ravel() for x in asked.values()]))
        for (name, x), part in zip(asked.items(), np.split(found, np.cumsum([x.size for x in asked.values()])[:-1]), strict=True):
            go_on(name, part.reshape(x.shape))
    return trees


class _Exchange:
    """Sums arrays over the n tasks of a barrier stage through a folder that all see.

    Each task leaves a file, the first one adds them up in the order of the tasks and leaves the total. A file is
    there under its name once it is whole. Nobody asks for the files of a round that all have gone beyond, so they are deleted.
    """

    def __init__(self, folder: str, me: int, n: int, patience: float = 3600.0):
        from pyarrow import fs

        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.me, self.n, self.round, self.patience = me, n, 0, patience
        self.system.create_dir(self.folder, recursive=True)

    def _leave(self, name: str, values: np.ndarray) -> None:
        with self.system.open_output_stream(f"{self.folder}/_{name}") as f:
            f.write(np.ascontiguousarray(values, np.float64).tobytes())
        self.system.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")

    def _take(self, name: str, size: int) -> np.ndarray:
        path, until, pause = f"{self.folder}/{name}", time.monotonic() + self.patience, 0.001
        while True:
            try:
                with self.system.open_input_file(path) as f:
                    values = np.frombuffer(f.read(), np.float64)
                break
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"no {path} of another task") from None
                time.sleep(pause)
                pause = min(pause * 1.2, 0.02)
        if len(values) != size:
            raise ValueError(f"tasks differ in what they sum: {len(values)} and {size} values")
        return values

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of the tasks' arrays, the same for all of them."""
        flat, k = np.asarray(values, np.float64).ravel(), self.round
        self.round += 1
        if self.n == 1:
            return flat.reshape(values.shape)
        if self.me:
            self._leave(f"{k}-{self.me}", flat)
            return self._take(f"{k}-all", flat.size).reshape(values.shape)
        out = flat.copy()
        for i in range(1, self.n):
            out += self._take(f"{k}-{i}", flat.size)
        self._leave(f"{k}-all", out)
        # all have left their files of this round, so all have taken the total before
        for name in (*(f"{k}-{i}" for i in range(1, self.n)), *([f"{k - 1}-all"] if k else [])):
            self.system.delete_file(f"{self.folder}/{name}")
        return out.reshape(values.shape)


def percentiles(values: np.ndarray, n: int) -> np.ndarray:
    """The distinct ones of the n - 1 percentiles that cut values into n parts, linear between two places."""
    if not len(values):
        return np.array([])
    s, (at, low, high) = np.sort(values), _places(len(values), n)
    return _between(at, low, high, s[low.astype(int)], s[high.astype(int)])


def _places(count: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where percentiles lie among so many values in order, and the places below and above."""
    at = (count - 1) * (np.arange(1, n) / n)
    return at, np.floor(at), np.ceil(at)


def _between(at: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def shared_percentiles(columns: Iterable[np.ndarray], n: int, total: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """percentiles of each column over the rows of all tasks: places in order are found by halving the range of values, which takes 64 sums of counts."""
    values, upto = [], []
    for c in columns:
        different, seen = np.unique(_ordered(c), return_counts=True)
        values.append(different)
        upto.append(np.concatenate([[0], np.cumsum(seen)]).astype(np.int32 if len(c) < 2**31 else np.int64))
    counts = total(np.array([float(u[-1]) for u in upto])).astype(np.int64)
    places = [_places(int(c), n) for c in counts]
    wanted = np.stack([np.concatenate([low, high]) for _, low, high in places])
    # the least number with more than so many values up to it
    lo, hi = np.full(wanted.shape, np.iinfo(np.int64).min), np.full(wanted.shape, np.iinfo(np.int64).max)
    for _ in range(64):
        middle = (lo >> 1) + (hi >> 1) + (lo & hi & 1)
        below = total(np.stack([u[np.searchsorted(v, m, "right")] for v, u, m in zip(values, upto, middle, strict=True)]).astype(float))
        lo, hi = np.where(below > wanted, lo, np.minimum(middle, np.iinfo(np.int64).max - 1) + 1), np.where(below > wanted, middle, hi)
    found = np.where(hi < 0, hi ^ np.int64(2**63 - 1), hi).view(np.float64)
    return [_between(*p, *np.split(x, 2)) if c else np.array([]) for p, x, c in zip(places, found, counts, strict=True)]


_TREES = "model string, base double, tree int, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>, edges array<array<double>>"


def fit(train: DataFrame, feature_sets: dict[str, list[str]], label: str, keys: list[str], settings: Settings = Settings(), most_rows: int | None = None, alone: int = ALONE) -> dict[str, Model]:
    """One model for each set of features, learned from all rows of train.

    Up to `alone` rows, each model is grown by a task of its own; more are dealt by their keys over
    tasks that run at the same time, as many as the cluster can run, but of a quarter as many rows each at least (with dynamic allocation one task has all). keys are columns that tell rows
    apart. Trees are the same however rows are dealt (see _step). Loss is the squared error. Bin edges
    are exact percentiles of all rows. Null labels are left out; null features stand in the last
    bin. Without rows models have the value 0. More rows than most_rows, if given, are an error.
    """
    names = list(dict.fromkeys(c for cs in feature_sets.values() for c in cs))
    plain = train.where(F.col(label).isNotNull()).select(*keys, F.col(label).cast("double").alias("label"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    # stored, since the rows are counted first
    rows = stored(plain, "training")
    n = rows.count()
    if most_rows is not None and n > most_rows:
        raise ValueError(f"{n} rows; a sample of at most {most_rows} is fitted")
    models = list(feature_sets)
    used = {model: [names.index(c) for c in cs] for model, cs in feature_sets.items()}

    def out_batch(model: str, base: float, trees: list[Tree], edges: list[np.ndarray]) -> pa.RecordBatch:
        out = [(model, base, i, k.feature, k.bin, k.left, k.right, k.value, None if i else edges) for i, k in enumerate(trees)]
        kinds = (pa.string(), pa.float64(), pa.int32(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _TREES.split(", ")])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by([(k, "ascending") for k in keys])
        model = models[t["model"][0].as_py()]
        edges = [percentiles(t[f"f{i}"].drop_null().to_numpy(), settings.bins) for i in used[model]]
        x = np.stack([t[f"f{i}"].to_pandas().to_numpy(float) for i in used[model]], axis=1)
        grower = _Grower(binned(x, edges), t["label"].to_numpy(), settings)
        yield out_batch(model, grower.base, [grower.tree() for _ in range(settings.rounds)], edges)

    def grow_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = BarrierTaskContext.get()
        # a folder for each attempt of the stage
        exchange = _Exchange(f"{folder}/{here.allGather(str(here.taskAttemptId()))[0]}", here.partitionId(), tasks)
        parts = [[np.empty(0)] for _ in range(len(names) + 1)]
        for batch in batches:
            for held, c in zip(parts, batch.columns, strict=True):
                held.append(np.array(c.to_pandas().to_numpy(float)))
        label, columns = np.concatenate(parts.pop(0)), []
        while parts:
            columns.append(np.concatenate(parts.pop(0)))
        edges = shared_percentiles((c[~np.isnan(c)] for c in columns), settings.bins, exchange.total)
        bins = np.empty((len(label), len(names)), np.uint8 if settings.bins < 256 else np.int32)
        for i, e in enumerate(edges):
            bins[:, i] = binned(columns[i][:, None], [e])[:, 0]
            columns[i] = np.empty(0)
        mine = np.zeros(tasks)
        mine[here.partitionId()] = np.abs(label).max(initial=0.0)
        step = _step(n, float(exchange.total(mine).max()))
        base = float(exchange.total(_rounded(label, step).sum(keepdims=True))[0] / n)
        growers = {m: _Grower(bins[:, used[m]], label, settings, (base, step)) for m in models}
        trees = _together(growers, settings.rounds, exchange.total)
        if not here.partitionId():
            for m in models:
                yield out_batch(m, growers[m].base, trees[m], [edges[i] for i in used[m]])

    # barrier stages need a fixed number of executors
    dynamic = rows.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    tasks = min(-(-n // max(1, alone // 4)), _slots(rows.sparkSession)) if n > alone and not dynamic else 1
    if tasks == 1:
        # by number, so that no two models meet in a task
        each = rows.withColumn("model", F.explode(F.array(*map(F.lit, range(len(models)))))).repartitionById(len(models), "model")
        found = each.mapInArrow(grow, _TREES)
    else:
        folder = f"{shared_dir(rows.sparkSession)}/sums-{uuid.uuid4().hex}"
        dealt = rows.repartitionById(tasks, F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int")).sortWithinPartitions(*keys)
        # with an exchange after it, as Spark starts only such a barrier stage anew when a task is lost
        found = dealt.drop(*keys).mapInArrow(grow_shared, _TREES, barrier=True).repartition(1)
    made = sorted(found.collect(), key=lambda r: r.tree)  # rounds x leaves numbers for each model
    out = {}
    for name, cs in feature_sets.items():
        mine = [r for r in made if r.model == name]
        edges = [np.array(e, float) for e in mine[0].edges] if mine else [np.array([])] * len(cs)
        out[name] = Model(cs, edges, mine[0].base if mine else 0.0, [Tree(r.feature, r.bin, r.left, r.right, r.value) for r in mine])
    return out


def _slots(spark: SparkSession) -> int:
    """Tasks that the cluster runs at the same time: a barrier stage of more would wait for ever."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def predicted(rows: DataFrame, models: dict[str, Model], out: dict[str, str] | None = None) -> DataFrame:
    """rows with a column of predictions for each model, named as the model or as `out` says."""
    named = out or {m: m for m in models}
    shared = rows.sparkSession.sparkContext.broadcast(models)  # rounds x leaves numbers for each model
    names = list(dict.fromkeys(c for m in models.values() for c in m.features))
    schema = rows.select("*", *[F.lit(0.0).alias(named[m]) for m in models]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch[c].cast(pa.float64()).to_pandas().to_numpy(float) for c in names], axis=1)
            scores = [pa.array(m.predict(x[:, [names.index(c) for c in m.features]])) for m in shared.value.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], names=schema.names)

    return rows.mapInArrow(run, schema)
