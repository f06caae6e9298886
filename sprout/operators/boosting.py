"""Gradient-boosted trees on quantile-binned features, second-order leaf values, fitted on every training row.

A tree grows from (node, feature, bin) sums of gradients, curvatures and rows. A tree takes
the best splits first, up to a number of leaves or a depth; nodes that may be split are
summed together, a depth at a time.

One algorithm has three plans. Up to ``TASK_ROWS`` rows a fit is one task, and several
fits are tasks of one job; only the smaller child of a split is summed, its sibling is the
difference. A ranked fit of ``LONE_ROWS`` to ``TEAM_ROWS`` rows is one task that asks for all
cores of an executor and deals whole groups to a process for each. Above, binned rows are a stored table of blocks; a job sums what a step of the
growing tree needs and finds each node's best split, the driver takes the splits in order,
and the scores are stored with the blocks every ``STORED_EVERY`` rounds, so that a
lost executor costs those few trees' scores at most. Quantiles are exact, row draws come from key
hashes, and gradients are rounded to a binary grid on which sums are exact, so all
plans, and all layouts of the rows, give equal trees.

Objectives: ``squared``, ``logistic``, and ``lambdarank`` (Burges, "From RankNet to
LambdaRank to LambdaMART", 2010): pairs of a group's ``TOP`` best-placed rows with all
rows placed lower, weighted by what their exchange changes in NDCG at ``TOP``. That is
linear in a group's rows, and a group may lie in several blocks.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing import Pipe
from multiprocessing.connection import Connection
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import md5_key
from ..session import discard_path, path_exists, store_at
from .common import run_concurrently

BINS = 64
TASK_ROWS = 500_000     # rows of a fit that one task takes
LONE_ROWS, TEAM_ROWS = 50_000, 4_000_000  # rows of a ranked fit that one core takes, and that one task with several takes
LEAST_ROWS, BLOCK_ROWS = 20_000, 250_000  # rows of a block of a larger fit
PLAIN_ROWS = 100_000    # the least where there are no pairs: shorter tasks cost more than their work
STORED_EVERY = 16       # rounds between stored scores
DIRECT_PARTS = 64       # sums of so many tasks are added up by one
TOP = 30                # places whose pairs a ranking gradient takes
WIDEST = 64             # rows of a small group
SQUARE_GROUPS = 256     # small groups of a size whose pairs are taken together, and
SQUARE_CELLS = 1 << 14  # pairs that are: what the cache holds
LEAST_GAIN = 1e-9


@dataclass
class Boosted:
    """Trees: feature, threshold and children of the inner nodes, root first, and leaf values.

    A child is an inner node's number, or ``~k`` for leaf k; without ``left`` and
    ``right`` the trees are complete, a depth after the other.
    """

    features: list[str]
    base: float
    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    value: list[np.ndarray]
    gain: np.ndarray        # per feature
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if not len(self.left):
            for t in self.feature:
                child, n = 2 * np.arange(len(t)) + 1, len(t)
                self.left.append(np.where(child < n, child, ~(child - n)))
                self.right.append(np.where(child + 1 < n, child + 1, ~(child + 1 - n)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(np.where(np.isnan(x), -np.inf, x).T)
        out = np.full(len(x), self.base)
        for feature, threshold, value, left, right in zip(self.feature, self.threshold, self.value, self.left, self.right):
            out += value[descend(columns, 0 if len(feature) else ~0, feature, threshold, left, right)]
        return out

    def importance(self) -> list[tuple[str, float]]:
        total = float(self.gain.sum()) or 1.0
        return [(f, float(g) / total) for f, g in zip(self.features, self.gain)]

    def to_json(self) -> str:
        plain = {k: [np.asarray(a).tolist() for a in v] if k in TREE_PARTS else v.tolist() if isinstance(v, np.ndarray) else v
                 for k, v in self.__dict__.items()}
        return json.dumps(plain)

    @classmethod
    def from_json(cls, text: str) -> "Boosted":
        x = json.loads(text)
        parts = {k: [np.array(a, float if k in ("threshold", "value") else int) for a in x[k]] for k in TREE_PARTS if k in x}
        return cls(x["features"], x["base"], gain=np.array(x["gain"]), **parts)


TREE_PARTS = ("feature", "threshold", "value", "left", "right")


def descend(columns: np.ndarray, start: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The end that each row reaches; children below zero are ends."""
    at = np.full(columns.shape[1], start)
    rows = np.arange(len(at)) if start >= 0 else np.zeros(0, int)
    while len(rows):
        node = at[rows]
        at[rows] = after = np.where(columns[feature[node], rows] > cut[node], right[node], left[node])
        rows = rows[after >= 0]
    return ~at


# ---------------------------------------------------------------- growth
class Shape(NamedTuple):
    depth: int
    leaves: int
    min_rows: int
    l2: float


class Split(NamedTuple):
    node: int
    feature: int
    cut: int
    left: int
    right: int
    left_larger: bool


class Node(NamedTuple):
    """What a tree knows of a node: its best split, and its gradient and curvature."""

    gain: float
    feature: int
    cut: int
    left_larger: bool
    g: float
    h: float


def best_splits(sums: np.ndarray, shape: Shape, closed: np.ndarray) -> list[Node]:
    """Nodes with (gradient, curvature, rows) sums by feature and bin."""
    left = sums.cumsum(3)
    total = left[..., -1:]
    (gl, hl, nl), (gt, ht, nt) = left.swapaxes(0, 1), total.swapaxes(0, 1)
    l2 = shape.l2
    with np.errstate(divide="ignore", invalid="ignore"):
        won = np.nan_to_num(gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2), nan=0.0, posinf=0.0, neginf=0.0)
    won[(nl < shape.min_rows) | (nt - nl < shape.min_rows)] = 0
    won[:, closed] = 0
    flat = won.reshape(len(sums), -1)
    out = []
    for k, at in enumerate(flat.argmax(1).tolist()):
        feature, cut = divmod(at, BINS)
        larger = bool(2 * nl[k, feature, cut] > nt[k, feature, 0])
        out.append(Node(float(flat[k, at]), feature, cut, larger, float(total[k, 0, 0, 0]), float(total[k, 1, 0, 0])))
    return out


class Growth:
    """A growing tree: every node that was looked at, whether the tree keeps it or not."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.depth, self.best, self.kids = [], [], []

    def add(self, found: list[Node], depths: Sequence[int]) -> None:
        self.best += found
        self.depth += depths
        self.kids += [None] * len(found)

    def may_split(self, node: int) -> bool:
        return self.best[node].gain > LEAST_GAIN and self.depth[node] < self.shape.depth

    def chosen(self) -> tuple[list[int], list[int]]:
        """Splits of the tree, best first, and the nodes to be summed before that is sure."""
        heap, kept, wanted, leaves = [(-self.best[0].gain, 0)] if self.may_split(0) else [], [], [], 1
        while heap and leaves < self.shape.leaves:
            _, node = heapq.heappop(heap)
            leaves += 1
            if self.kids[node] is None:
                wanted.append(node)
                continue
            kept.append(node)
            for kid in self.kids[node]:
                if self.may_split(kid):
                    heapq.heappush(heap, (-self.best[kid].gain, kid))
        return kept, wanted

    def widen(self, nodes: list[int], parted: Callable) -> None:
        """Split the nodes."""
        splits, first = [], len(self.best)
        for k, node in enumerate(nodes):
            own = self.best[node]
            self.kids[node] = first + 2 * k, first + 2 * k + 1
            splits.append(Split(node, own.feature, own.cut, *self.kids[node], own.left_larger))
        self.add(parted(splits), [self.depth[n] + 1 for n in nodes for _ in (0, 1)])

    def finish(self, kept: list[int], rate: float) -> tuple:
        """(feature, cut, value, left, right) of the tree, and the leaf of every node."""
        number, leaf = {n: k for k, n in enumerate(kept)}, np.zeros(len(self.best), int)
        value, todo = [], [(0, None)]
        code = {}
        while todo:
            node, own = todo.pop()
            if own is None and node not in number:
                g, h = self.best[node].g, self.best[node].h
                own = len(value)
                value.append(-rate * g / (h + self.shape.l2) if h + self.shape.l2 > 0 else 0.0)
                code[node] = ~own
            leaf[node] = own if own is not None else -1
            todo += [(kid, own) for kid in reversed(self.kids[node] or ())]
        code |= number
        left, right = (np.array([code[self.kids[n][s]] for n in kept], int) for s in (0, 1))
        feature, cut = np.array([self.best[n].feature for n in kept], int), np.array([self.best[n].cut for n in kept], int)
        return (feature, cut, np.array(value), left, right), leaf


def boost(rows, features: Sequence[str], base: float, edges: list[np.ndarray], shape: Shape, rounds: int, rate: float,
          seed: int, columns: float) -> Boosted:
    """All rounds over ``rows``, which gives nodes and takes finished trees (``TaskRows`` or ``SpreadRows``)."""
    rng, f = np.random.default_rng(seed), len(features)
    out = Boosted(list(features), base, [], [], [], np.zeros(f))
    for r in range(rounds):
        closed = np.ones(f, bool)
        closed[rng.choice(f, max(1, round(columns * f)), replace=False)] = False
        tree, search = Growth(shape), functools.partial(best_splits, shape=shape, closed=closed)
        tree.add(rows.root(r, search), [0])
        while (now := tree.chosen())[1]:
            tree.widen(now[1], functools.partial(rows.parted, search=search))
        kept = now[0]
        (feature, cut, value, left, right), leaf = tree.finish(kept, rate)
        for part, x in zip(TREE_PARTS, (feature, np.array([edges[j][c] for j, c in zip(feature, cut)], float), value, left, right)):
            getattr(out, part).append(x)
        np.add.at(out.gain, feature, [tree.best[n].gain for n in kept])
        rows.finished((feature, cut, value, left, right), leaf)
    return out


# ---------------------------------------------------------------- rows
def pair_units(head: tuple, row: tuple, fall, weight) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature on the lower-placed row of a pair, in units of the grid; the head's gradient is the negative.

    ``head`` and ``row`` are (score, gain), ``fall`` the discount that the row's place lacks,
    ``weight`` the inverse of the best DCG over the grid."""
    (hs, hg), (rs, rg) = head, row
    step = hg - rg
    away = np.exp(np.copysign(np.minimum(hs - rs, 60), step).astype(np.float32))  # the grid is no finer
    away += 1
    rho = np.divide(1, away, out=away)
    step *= fall
    step *= weight  # the grid is a power of two: products are exact
    step *= rho
    bend = np.abs(step)
    bend *= np.subtract(1, rho, out=rho)
    return np.rint(step, out=step), np.rint(bend, out=bend)


def pair(head: tuple, row: tuple, fall, inverse, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature on the lower-placed row of a pair."""
    step, bend = pair_units(head, row, fall, inverse / grid)
    step *= grid
    bend *= grid
    return step, bend


DISCOUNT = np.append(1 / np.log2(np.arange(TOP) + 2), 0.0)


def discount(place: np.ndarray) -> np.ndarray:
    return DISCOUNT[np.minimum(place, TOP)]


def inverse_of(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """1 / the sum of each run of terms of a best DCG (0 for nothing), summed on a grid so that order doesn't matter."""
    best = np.add.reduceat(np.rint(terms * 2.0 ** 32), starts) * 2.0 ** -32
    return np.divide(1.0, best, out=np.zeros_like(best), where=best > 0)


class Cut(NamedTuple):
    """A group that lies in several blocks: its top rows and what all its pairs add to them."""

    score: np.ndarray
    gain: np.ndarray
    draw: np.ndarray
    inverse: float
    g: np.ndarray
    h: np.ndarray


class Square(NamedTuple):
    """Small groups of one size, by falling gain (rows x groups). Pairs of equal gain add nothing, so heads come
    in runs with the first row that has less gain in some group."""

    rows: np.ndarray
    gain: np.ndarray    # a column does where all groups have the same
    inverse: np.ndarray
    runs: list[tuple[int, int, int]]

    @classmethod
    def of(cls, at: np.ndarray, gain: np.ndarray, inverse: np.ndarray) -> "Square":
        """``at`` has the groups' rows, groups x rows."""
        rows = np.ascontiguousarray(np.take_along_axis(at, np.argsort(-gain[at], 1, kind="stable"), 1).T)
        gain, size = gain[rows], len(rows)
        first = [max([t + 1, *(np.flatnonzero((gain[t + 1:] < gain[t]).any(1))[:1] + t + 1).tolist()])
                 if (gain[-1] < gain[t]).any() else size for t in range(size)]
        runs = [(first.index(f), first.index(f) + first.count(f), f) for f in sorted({*first} - {size})]
        return cls(rows, gain[:, :1] if (gain == gain[:, :1]).all() else gain, inverse, runs)

    def units(self, score: np.ndarray, off: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures of the rows in units of the grid; ``off`` is the discount of each row's place.
        Operations are those of ``pair_units``, so that results are equal bit for bit."""
        s, off, weight = score[self.rows], off[self.rows], self.inverse / grid
        dg, dh = np.zeros(s.shape), np.zeros(s.shape)
        far = s.max() - s.min() > 60
        for lo, hi, first in self.runs:
            width = (len(s) - first) * s.shape[1]
            some = max(1, SQUARE_CELLS // width)
            both, single = np.empty((2, min(some, hi - lo) * width)), np.empty(min(some, hi - lo) * width, np.float32)
            for a in range(lo, hi, some):
                b = min(hi, a + some)
                step, bend, rho = (x[:(b - a) * width].reshape(b - a, -1, s.shape[1]) for x in (*both, single))
                np.subtract(s[a:b, None], s[first:], out=step)
                rho[...] = np.clip(step, -60, 60, out=step) if far else step
                np.exp(rho, out=rho)
                rho += 1
                np.divide(1, rho, out=rho)
                np.subtract(off[a:b, None], off[first:], out=step)
                np.abs(step, out=step)
                step *= self.gain[a:b, None] - self.gain[first:]
                step *= weight
                step *= rho
                np.multiply(step, np.subtract(1, rho, out=rho), out=bend)
                np.rint(step, out=step)
                np.rint(bend, out=bend)
                dg[first:] += step.sum(0)
                dg[a:b] -= step.sum(1)
                dh[first:] += bend.sum(0)
                dh[a:b] += bend.sum(1)
        return dg, dh


class Block:
    """Binned rows; ranked rows are sorted by group and draw, so only a block's end groups go on in others."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, draw: np.ndarray, code: np.ndarray, score: np.ndarray, ends: tuple = ()):
        self.bins, self.y, self.draw, self.code, self.score, self.ends = bins, y, draw, code, score, ends
        self.best: np.ndarray | None = None  # 1 / best DCG of each group
        self.gain: np.ndarray | None = None
        self.squares: list | None = None

    @classmethod
    def of(cls, row: dict) -> "Block":
        n, ends = row["n"], (row["a"], row["b"])
        y, draw, code, score = (np.frombuffer(row[c], t) for c, t in (("y", "<f8"), ("draw", "<u8"), ("code", "<i4"), ("score", "<f8")))
        return cls(np.frombuffer(row["bins"], np.uint8).reshape(-1, n), y, draw, code, score, ends)

    def after(self, trees: list[tuple]) -> np.ndarray:
        score = self.score
        for feature, cut, value, left, right in trees:
            score = score + value[descend(self.bins, 0 if len(feature) else ~0, feature, cut, left, right)]
        return score

    def used(self, r: int, seed: int, share: float) -> np.ndarray:
        """The rows a round draws, by their key hash."""
        if share >= 1:
            return np.ones(len(self.y), bool)
        z = self.draw + np.uint64((0x9E3779B97F4A7C15 * (seed * 100_003 + r + 1)) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) < share * 2.0 ** 53

    def slopes(self, objective: str, score: np.ndarray, grid: float, cut: dict[str, Cut]) -> tuple[np.ndarray, np.ndarray | None]:
        """Gradients and curvatures (None: all one) on the grid."""
        if objective == "squared":
            return np.rint((score - self.y) / grid) * grid, None
        if objective == "logistic":
            p = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
            return np.rint((p - self.y) / grid) * grid, np.rint(np.maximum(p * (1 - p), 1e-9) / grid) * grid
        return self.lambdas(score, grid, cut)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """First row of each group, and the rows of each."""
        starts = np.flatnonzero(np.diff(self.code, prepend=-1))
        return starts, np.diff(np.append(starts, len(self.code)))

    def placed(self, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by group and falling value (ties by draw), and each row's place in its group."""
        starts, _ = self.groups()
        order = np.lexsort((-by, self.code))
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order)) - starts[self.code[order]]
        return order, place

    def inverse(self) -> np.ndarray:
        """1 / best DCG of each group, 0 where nothing is relevant."""
        if self.best is None:
            gain = 2.0 ** self.y - 1
            order, place = self.placed(gain)
            self.best = inverse_of((gain * discount(place))[order], self.groups()[0])
        return self.best

    def squared_up(self, whole: np.ndarray, gain: np.ndarray) -> list[tuple[np.ndarray, Square]]:
        """Row numbers of the small whole groups by draw, and what doesn't change of their pairs, some groups at a time."""
        (starts, sizes), inverse = self.groups(), self.inverse()
        out = []
        for size in np.unique(sizes[whole & (sizes <= WIDEST)]):
            same = np.flatnonzero(whole & (sizes == size))
            for lo in range(0, len(same), SQUARE_GROUPS):
                some = same[lo:lo + SQUARE_GROUPS]
                at = starts[some, None] + np.arange(size)
                out.append((at, Square.of(at, gain, inverse[some])))
        return out

    def lambdas(self, score: np.ndarray, grid: float, cut: dict[str, Cut]) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = self.groups()
        if self.gain is None:
            self.gain = 2.0 ** self.y - 1
        gain, n = self.gain, len(score)
        g, h, whole = np.zeros(n), np.zeros(n), np.ones(len(starts), bool)
        for k, key in self.end_groups():
            if key in cut:
                whole[k] = False
                own = slice(starts[k], starts[k] + sizes[k])
                g[own], h[own] = self.against(cut[key], score[own], gain[own], self.draw[own], grid)[:2]
        inverse = self.inverse()
        if self.squares is None:
            self.squares = self.squared_up(whole, gain)
        off = np.zeros(n)
        for at, square in self.squares:
            order = np.argsort(-score[at], 1, kind="stable")
            off[np.take_along_axis(at, order, 1)] = discount(np.arange(at.shape[1]))
            dg, dh = square.units(score, off, grid)
            g[square.rows], h[square.rows] = dg * grid, dh * grid
        large = whole & (sizes > WIDEST)
        if large.any():
            order, place = self.placed(score)
            off = discount(place)
            rows = order[large[self.code[order]]]
            for t in range(TOP):
                rows = rows[place[rows] > t]
                head = order[starts[self.code[rows]] + t]
                dg, dh = pair((score[head], gain[head]), (score[rows], gain[rows]), DISCOUNT[t] - off[rows], inverse[self.code[rows]], grid)
                g[rows] += dg
                h[rows] += dh
                g -= np.bincount(head, dg, n)
                h += np.bincount(head, dh, n)
        return g, h

    def end_groups(self) -> list[tuple[int, str]]:
        last = int(self.code[-1])
        return [(0, self.ends[0])] + [(last, self.ends[1])] * (last > 0) if self.ends else []

    @staticmethod
    def against(cut: Cut, score: np.ndarray, gain: np.ndarray, draw: np.ndarray, grid: float) -> tuple:
        """Gradients and curvatures of a cut group's own rows, and what they add to its top rows."""
        order = np.argsort(cut.draw)
        at = order[np.minimum(np.searchsorted(cut.draw[order], draw), len(order) - 1)]
        top = cut.draw[at] == draw
        place = np.where(top, at, TOP)
        g, h = np.where(top, cut.g[at], 0.0), np.where(top, cut.h[at], 0.0)
        added, off = np.zeros((2, len(order))), discount(place)
        for t in range(len(order)):
            rows = np.flatnonzero(place > t)
            dg, dh = pair((cut.score[t], cut.gain[t]), (score[rows], gain[rows]), DISCOUNT[t] - off[rows], cut.inverse, grid)
            g[rows] += dg
            h[rows] += dh
            added[:, t] = -dg.sum(), dh.sum()
        return g, h, added

    def binned_sums(self, slot: np.ndarray, n_slots: int, g: np.ndarray, h: np.ndarray | None) -> np.ndarray:
        """(slot, 3, feature, bin) sums over the rows whose slot isn't negative."""
        rows = np.flatnonzero(slot >= 0)
        base, size = slot[rows] * BINS, n_slots * BINS
        gw, hw = g[rows], None if h is None else h[rows]
        out = np.empty((3, len(self.bins), size))
        for j, bins in enumerate(self.bins):
            key = base + bins[rows]
            out[0, j], out[2, j] = np.bincount(key, gw, size), np.bincount(key, minlength=size)
            out[1, j] = out[2, j] if h is None else np.bincount(key, hw, size)
        return out.reshape(3, len(self.bins), n_slots, BINS).transpose(2, 0, 1, 3)


def bundles(bins: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Features that are summed in one pass, and their bins: few-valued ones go with others."""
    sizes, out = bins.max(1, initial=0).astype(int) + 1, []
    for j in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[j])
        fits = next((x for x in out if math.prod(x[1]) * size <= BINS * BINS), None)
        if fits is None:
            out.append(fits := ([], []))
        fits[0].append(j)
        fits[1].append(size)
    return out


class TaskRows:
    """All rows of a fit in one task."""

    def __init__(self, block: Block, objective: str, grid: float, seed: int, share: float):
        self.block, self.objective, self.grid, self.seed, self.share = block, objective, grid, seed, share
        self.joint = [(own, sizes, self.keys(own, sizes)) for own, sizes in bundles(block.bins)]

    def keys(self, own: list[int], sizes: list[int]) -> np.ndarray:
        out = np.zeros(len(self.block.y), np.int16)
        for j, size in zip(own, sizes):
            out *= size
            out += self.block.bins[j]
        return out

    def begun(self, r: int) -> np.ndarray:
        """The sums of a new tree's root."""
        b = self.block
        self.g, self.h = b.slopes(self.objective, b.score, self.grid, {})
        self.use = b.used(r, self.seed, self.share)
        self.rows = {0: np.flatnonzero(self.use)}
        return self.sums([0])

    def root(self, r: int, search: Callable) -> list[Node]:
        found = self.begun(r)
        self.of = {0: found[0]}
        return search(found)

    def sums(self, nodes: list[int]) -> np.ndarray:
        """(node, 3, feature, bin) sums over the drawn rows of each node."""
        out = np.zeros((len(nodes), 3, len(self.block.bins), BINS))
        for k, node in enumerate(nodes):
            rows = self.rows[node]
            g, h = self.g.take(rows), None if self.h is None else self.h.take(rows)
            if len(rows) > BINS * BINS:
                for own, sizes, keys in self.joint:
                    key, cells = keys.take(rows).astype(np.intp), math.prod(sizes)
                    for i, w in enumerate((g, h, None)):
                        if i != 1 or h is not None:
                            found = np.bincount(key, w, cells).reshape(sizes)  # exact on the grid
                            for a, (j, size) in enumerate(zip(own, sizes)):
                                out[k, i, j, :size] = found.sum(tuple(x for x in range(len(own)) if x != a))
            else:
                for j, bins in enumerate(self.block.bins):
                    key = bins.take(rows).astype(np.intp)
                    out[k, 0, j], out[k, 2, j] = np.bincount(key, g, BINS), np.bincount(key, minlength=BINS)
                    if h is not None:
                        out[k, 1, j] = np.bincount(key, h, BINS)
            if h is None:
                out[k, 1] = out[k, 2]
        return out

    def smaller(self, splits: list[Split]) -> np.ndarray:
        """The sums of the smaller child of each split."""
        for s in splits:
            rows = self.rows.pop(s.node)
            above = self.block.bins[s.feature].take(rows) > s.cut
            self.rows[s.left], self.rows[s.right] = rows.compress(~above), rows.compress(above)  # a mask as index is slower
        return self.sums([s.right if s.left_larger else s.left for s in splits])

    def parted(self, splits: list[Split], search: Callable) -> list[Node]:
        """The children of the splits, in order; only the smaller child of each is summed."""
        found = self.smaller(splits)
        both = np.empty((2 * len(splits), *found.shape[1:]))
        for k, s in enumerate(splits):
            both[2 * k + s.left_larger] = found[k]
            both[2 * k + 1 - s.left_larger] = self.of.pop(s.node) - found[k]
            self.of[s.left], self.of[s.right] = both[2 * k], both[2 * k + 1]
        return search(both)

    def finished(self, tree: tuple, leaf: np.ndarray) -> None:
        (feature, cut, value, left, right), score = tree, self.block.score
        for node, rows in self.rows.items():  # the ends of the widened tree hold each drawn row once
            score[rows] += value[leaf[node]]
        rest = np.flatnonzero(~self.use)
        score[rest] += value[descend(self.block.bins[:, rest], 0 if len(feature) else ~0, feature, cut, left, right)]


class TeamRows(TaskRows):
    """All rows of a fit in one task that has several cores: each process has some whole groups, the task's own
    adds up their sums and searches them. Helpers end with the pipe to it."""

    def __init__(self, block: Block, cores: int, *options):
        starts, (n, most) = block.groups()[0], (len(block.y), max(1, cores))
        ends = np.append(starts, n)
        cuts = np.unique(ends[np.searchsorted(ends, np.arange(most + 1) * n // most)]).tolist()
        shards = [Block(block.bins[:, a:b], block.y[a:b], block.draw[a:b], block.code[a:b] - block.code[a], block.score[a:b])
                  for a, b in zip(cuts, cuts[1:])]
        self.helpers: list[tuple[int, Connection]] = []
        for shard in shards[1:]:
            here, there = Pipe()
            if not (pid := os.fork()):
                here.close()
                for _, other in self.helpers:
                    other.close()
                help_out(there, shard, options)
            there.close()
            self.helpers.append((pid, here))
        super().__init__(shards[0], *options)

    def ask(self, what: str, *given) -> None:
        for _, pipe in self.helpers:
            pipe.send((what, given))

    def summed(self, found: np.ndarray) -> np.ndarray:
        for _, pipe in self.helpers:
            found += pipe.recv()
        return found

    def begun(self, r: int) -> np.ndarray:
        self.ask("begun", r)
        return self.summed(super().begun(r))

    def smaller(self, splits: list[Split]) -> np.ndarray:
        self.ask("smaller", splits)
        return self.summed(super().smaller(splits))

    def finished(self, tree: tuple, leaf: np.ndarray) -> None:
        self.ask("finished", tree, leaf)
        super().finished(tree, leaf)

    def close(self) -> None:
        for pid, pipe in self.helpers:
            pipe.close()
            os.waitpid(pid, 0)


def help_out(pipe: Connection, shard: Block, options: tuple) -> None:
    """What a helper does until its pipe is closed; it never returns."""
    try:
        rows = TaskRows(shard, *options)
        while True:
            what, given = pipe.recv()
            if (found := getattr(rows, what)(*given)) is not None:
                pipe.send(found)
    finally:
        os._exit(0)


BLOCKS = "part int, n int, bins binary, y binary, draw binary, code binary, score binary, a string, b string"
BLOCK_SCHEMA = pa.schema([pa.field("part", pa.int32()), pa.field("n", pa.int32()),
                          *[pa.field(c, pa.binary()) for c in ("bins", "y", "draw", "code", "score")],
                          pa.field("a", pa.string()), pa.field("b", pa.string())])


class SpreadRows:
    """Rows of a fit as blocks, a partition each, from a stored table; a call of ``root`` or ``parted`` is one job
    (a cut group two more a round). Slopes are taken once a round. Sums are added up and searched in the cluster:
    the driver gets a split a node."""

    def __init__(self, table: DataFrame, path: str, parts: int, objective: str, grid: float, seed: int, share: float):
        self.path, self.parts, self.objective, self.grid, self.seed, self.share = path, parts, objective, grid, seed, share
        self.inverse: dict[str, float] | None = None
        self.round: RDD | None = None
        self.load(table)

    def load(self, table: DataFrame) -> None:
        self.table, self.pending = table, []
        keyed = table.rdd.map(lambda r: (r["part"], r.asDict())).partitionBy(self.parts, int)
        self.blocks = keyed.mapValues(Block.of).values().persist(StorageLevel.MEMORY_AND_DISK)

    def cut_groups(self) -> dict[str, Cut]:
        """The groups at the ends of blocks: their top rows, then the sums over all their pairs."""
        trees, known, grid = list(self.pending), self.inverse, self.grid

        def tops(b: Block) -> list[tuple]:
            score, gain = b.after(trees), 2.0 ** b.y - 1
            starts, sizes = b.groups()
            out = []
            for k, key in b.end_groups():
                own = np.arange(starts[k], starts[k] + sizes[k])
                top = own[np.lexsort((b.draw[own].view(np.int64), -score[own]))[:TOP]]
                out.append((key, score[top], gain[top], b.draw[top], np.sort(gain[own])[::-1][:TOP] if known is None else None))
            return out

        found: dict[str, list] = {}
        for key, *rest in self.blocks.flatMap(tops).collect():
            found.setdefault(key, []).append(rest)
        found = {k: v for k, v in found.items() if len(v) > 1}
        if known is None:
            self.inverse = {}
            for key, rs in found.items():
                best = np.sort(np.concatenate([r[3] for r in rs]))[::-1][:TOP]
                self.inverse[key] = float(inverse_of(best * discount(np.arange(len(best))), np.zeros(1, int))[0])
        heads = {}
        for key, rs in found.items():
            score, gain, draw = (np.concatenate([r[c] for r in rs]) for c in range(3))
            top = np.lexsort((draw.view(np.int64), -score))[:TOP]
            heads[key] = Cut(score[top], gain[top], draw[top], self.inverse[key], np.zeros(len(top)), np.zeros(len(top)))
        if not heads:
            return {}

        def add(b: Block) -> list[tuple]:
            score, gain = b.after(trees), 2.0 ** b.y - 1
            starts, sizes = b.groups()
            out = []
            for k, key in b.end_groups():
                if key in heads:
                    own = slice(starts[k], starts[k] + sizes[k])
                    out.append((key, Block.against(heads[key], score[own], gain[own], b.draw[own], grid)[2]))
            return out

        sums = {k: np.zeros((2, len(c.score))) for k, c in heads.items()}
        for key, added in self.blocks.flatMap(add).collect():
            sums[key] += added
        return {k: c._replace(g=sums[k][0], h=sums[k][1]) for k, c in heads.items()}

    def job(self, wanted: list[int], search: Callable) -> list[Node]:
        """The wanted nodes, from their sums over all blocks."""
        (feature, cut, left, right), start, n = self.nodes(), 0 if self.splits else ~0, len(wanted)
        tasks = min(n, 1 + self.parts // DIRECT_PARTS)
        slot = np.full(len(feature), -1)
        slot[wanted] = np.arange(n)

        def run(part: Iterator[tuple]) -> Iterator[tuple]:
            for bins, use, g, h in part:
                own = slot[descend(bins, start, feature, cut, left, right)]
                sums = Block(bins, g, g, g, g).binned_sums(np.where(use, own, -1), n, g, h)
                yield from ((k, sums[k::tasks]) for k in range(tasks))

        def find(part: Iterator[tuple]) -> Iterator[tuple]:
            total: dict[int, np.ndarray] = {}
            for k, sums in part:
                total[k] = total[k] + sums if k in total else sums
            return ((k, search(sums)) for k, sums in total.items())

        out: list = [None] * n
        for k, found in self.round.mapPartitions(run).partitionBy(tasks, int).mapPartitions(find).collect():
            out[k::tasks] = found
        return out

    def nodes(self) -> list[np.ndarray]:
        """The growing tree by node number; ends are ``~node``."""
        size = self.splits[-1].right + 1 if self.splits else 1
        out = [np.zeros(size, int) for _ in range(4)]
        inner = {s.node for s in self.splits}
        for s in self.splits:
            for part, x in zip(out, (s.feature, s.cut, *[k if k in inner else ~k for k in (s.left, s.right)])):
                part[s.node] = x
        return out

    def root(self, r: int, search: Callable) -> list[Node]:
        cuts = self.cut_groups() if self.objective == "lambdarank" and self.inverse != {} else {}
        trees, objective, grid, seed, share = list(self.pending), self.objective, self.grid, self.seed, self.share

        def slopes(b: Block) -> tuple:
            return b.bins, b.used(r, seed, share), *b.slopes(objective, b.after(trees), grid, cuts)

        before, self.splits = self.round, []
        self.round = self.blocks.map(slopes).persist(StorageLevel.MEMORY_AND_DISK)
        found = self.job([0], search)
        if before is not None:
            before.unpersist()
        return found

    def parted(self, splits: list[Split], search: Callable) -> list[Node]:
        """The children of the splits, in order."""
        self.splits += splits
        return self.job([kid for s in splits for kid in (s.left, s.right)], search)

    def finished(self, tree: tuple, leaf: np.ndarray) -> None:
        self.pending.append(tree)
        if len(self.pending) < STORED_EVERY:
            return
        trees = self.pending

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    row["score"] = Block.of(row).after(trees).tobytes()
                    yield pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

        table, path = store_at(self.table.mapInArrow(run, BLOCKS), "boost-blocks")
        self.close()
        self.path = path
        self.load(table)

    def close(self) -> None:
        self.blocks.unpersist()
        if self.round is not None:
            self.round.unpersist()
            self.round = None
        discard_path(self.table.sparkSession, self.path)


# ---------------------------------------------------------------- fits
def marks(n: int) -> list[int]:
    """Places of the inner quantiles in ``n`` sorted values."""
    return sorted({((n - 1) * k) // BINS for k in range(1, BINS)})


def exact_edges(known: DataFrame, f: int, n: int) -> list[np.ndarray]:
    """Quantiles of all features, exact: counted values are range-partitioned, and each partition knows its rows before."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = known.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"x{j}").alias("x")) for j in range(f)])).alias("v"))
    counted = values.groupBy("v.j", "v.x").agg(F.count("*").alias("n"))
    sorted_, path = store_at(counted.repartitionByRange(parts, "j", "x").sortWithinPartitions("j", "x")
                             .withColumn("at", F.monotonically_increasing_id()), "boost-values")
    own = Window.partitionBy("part", "j").orderBy("at")
    numbered = sorted_.withColumn("part", F.shiftright("at", 33)).withColumn("to", F.sum("n").over(own))
    before, wanted = {}, []
    for r in sorted(numbered.groupBy("part", "j").agg(F.sum("n").alias("n")).collect()):  # a row a partition and feature
        low = before.get(r["j"], 0)
        wanted += [(r["part"], r["j"], m - low) for m in marks(n) if low <= m < low + r["n"]]
        before[r["j"]] = low + r["n"]
    spark = known.sparkSession
    places = spark.createDataFrame(wanted, "p long, f int, place long")
    hit = numbered.join(F.broadcast(places), (F.col("part") == F.col("p")) & (F.col("j") == F.col("f"))
                        & (F.col("place") < F.col("to")) & (F.col("place") >= F.col("to") - F.col("n")))
    out: list[list] = [[] for _ in range(f)]
    for r in hit.select("j", "x").distinct().collect():
        out[r["j"]].append(r["x"])
    discard_path(spark, path)
    return [np.unique(x) for x in out]


def code_of(groups: pa.Array) -> np.ndarray:
    """Numbers of sorted groups, in order."""
    if not len(groups):
        return np.zeros(0, np.int32)
    names = np.asarray(groups.dictionary_encode().indices)
    return np.cumsum(np.append(0, names[1:] != names[:-1]), dtype=np.int32)


def bin_rows(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x).astype(np.uint8) for e, x in zip(edges, columns)])


def fit_many(train: DataFrame, features: Sequence[str], targets: dict[str, tuple[str, str]], keys: Sequence[str], rounds: int,
             depth: int, rate: float, seed: int = 42, group: str | None = None, leaves: int | None = None, min_rows: int = 1,
             l2: float = 1.0, rows: float = 0.9, columns: float = 0.9) -> dict[str, Boosted]:
    """Fit a model per entry of ``targets`` (name -> column, objective) on all rows that have the target.

    ``keys`` name a row. Rows that repeat one exactly are drawn together. A model is the same
    whatever other targets it is fitted with.
    """
    features, f, names = list(features), len(features), list(targets)
    shape = Shape(depth, leaves or 1 << depth, min_rows, l2)
    plain = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-math.inf)), F.lit(-math.inf))
    known = train.select(*[plain(c).alias(f"x{j}") for j, c in enumerate(features)],
                         *[F.col(targets[k][0]).cast("double").alias(f"y{i}") for i, k in enumerate(names)], F.xxhash64(*keys).alias("key"),
                         F.coalesce(F.col(group).cast("string") if group else F.lit(""), F.lit("")).alias("g"))
    xs, ys = [f"x{j}" for j in range(f)], [f"y{i}" for i in range(len(names))]
    known, path = store_at(known.withColumn("draw", F.xxhash64("key", *xs)).drop("key"), "boost-rows")
    stats = known.agg(*[a.alias(f"{n}{y}") for y in ys for n, a in (("n", F.count(y)), ("top", F.max(F.abs(y))))]).first()
    scale = {y: 2.0 ** math.ceil(math.log2(max(stats[f"top{y}"] or 0, 1e-9))) for y in ys}
    unit = {y: scale[y] * 2.0 ** -40 for y in ys}
    sums = known.agg(*[F.sum(F.rint(F.col(y) / unit[y]).cast("decimal(20,0)")).alias(y) for y in ys]).first()
    todo, out = {}, {}
    for name, y in zip(names, ys):
        objective, n = targets[name][1], stats[f"n{y}"]
        if not n:
            raise ValueError(f"no training row has {targets[name][0]}")
        mean = int(sums[y]) * unit[y] / n
        bits = math.ceil(math.log2(n + 1)) + (5 if objective == "lambdarank" else 0)
        grid = (4 * scale[y] if objective == "squared" else 1.0) * 2.0 ** -min(26, 51 - bits)
        if objective == "logistic":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            base = math.log(mean / (1 - mean))
        else:
            base = mean if objective == "squared" else 0.0
        todo[name] = (y, objective, n, base, grid)

    small = {k: v for k, v in todo.items() if v[2] <= (min(TASK_ROWS, LONE_ROWS) if v[1] == "lambdarank" else TASK_ROWS)}
    if small:
        wide = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(v[0]).alias("y")) for k, v in small.items()]))
        long = known.select(*xs, "g", "draw", wide.alias("m")).select(*xs, "g", "draw", "m.*").where("y IS NOT NULL")

        def fit(t: pa.Table) -> pa.Table:
            name = t["model"][0].as_py()
            _, objective, n, base, grid = small[name]
            t = t.sort_by([("g", "ascending"), ("draw", "ascending"), ("y", "ascending")]).combine_chunks()
            x = [t[c].to_numpy() for c in xs]
            at = marks(n)
            edges = [np.unique(np.sort(v)[at]) for v in x]
            block = Block(bin_rows(x, edges), t["y"].to_numpy(), t["draw"].to_numpy().view(np.uint64), code_of(t["g"].combine_chunks()),
                          np.full(n, base))
            model = boost(TaskRows(block, objective, grid, seed, rows), features, base, edges, shape, rounds, rate, seed, columns)
            return pa.table({"model": [name], "trees": [model.to_json()]})

        # tasks are few and long: more partitions than models, so that two seldom share one
        done = long.repartition(8 * len(small), "model").groupBy("model").applyInArrow(fit, "model string, trees string").collect()
        out |= {r["model"]: Boosted.from_json(r["trees"]) for r in done}

    def spread(y: str, objective: str, n: int, base: float, grid: float) -> Boosted:
        own = known.where(F.col(y).isNotNull()).select(*xs, F.col(y).alias("y"), "draw", "g")
        fit = fit_team if objective == "lambdarank" and n <= TEAM_ROWS else fit_spread
        return fit(own, features, objective, n, base, grid, shape, rounds, rate, seed, rows, columns)

    large = [k for k in names if k not in small]
    if large:  # their many short jobs overlap
        out |= zip(large, run_concurrently([functools.partial(spread, *todo[k]) for k in large], max_workers=len(large)))
    discard_path(train.sparkSession, path)
    return out


def packed(known: DataFrame, f: int, objective: str, n: int, base: float, edges: list[np.ndarray]) -> tuple[DataFrame, str, int]:
    """A stored table of blocks of binned rows, its path and the number of its parts."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        bins = bin_rows([t[f"x{j}"].to_numpy() for j in range(f)], edges)
        packed = [bins, t["y"].to_numpy(), t["draw"].to_numpy(), code_of(t["g"].combine_chunks()), np.full(t.num_rows, base)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([t.num_rows], pa.int32()),
             *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in packed],
             pa.array([t["g"][0].as_py()], pa.string()), pa.array([t["g"][-1].as_py()], pa.string())], schema=BLOCK_SCHEMA)

    spread = known.sparkSession.sparkContext.defaultParallelism
    ranked = objective == "lambdarank"
    least = LEAST_ROWS if ranked else PLAIN_ROWS
    parts = max(-(-n // BLOCK_ROWS), min(spread, -(-n // least)))  # rows are dealt evenly: a key's rows have their own draws
    dealt = known.repartitionByRange(parts, "g", "draw").sortWithinPartitions("g", "draw", "y") if ranked else known.repartition(parts)
    return *store_at(dealt.mapInArrow(pack, BLOCKS), "boost-blocks"), parts


def fit_spread(known: DataFrame, features: list[str], objective: str, n: int, base: float, grid: float, shape: Shape, rounds: int,
               rate: float, seed: int, share: float, columns: float) -> Boosted:
    """A fit over stored blocks of binned rows."""
    edges = exact_edges(known, len(features), n)
    table, path, parts = packed(known, len(features), objective, n, base, edges)
    rows = SpreadRows(table, path, parts, objective, grid, seed, share)
    try:
        return boost(rows, features, base, edges, shape, rounds, rate, seed, columns)
    finally:
        rows.close()


def joined(blocks: list[Block]) -> Block:
    """Blocks in order as one; a group that goes on in the next block is one."""
    codes, last = [], 0
    for k, b in enumerate(blocks):
        last += k > 0 and b.ends[0] != blocks[k - 1].ends[1]
        codes.append(b.code + np.int32(last))
        last = int(codes[-1][-1])
    y, draw, score = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("y", "draw", "score"))
    return Block(np.concatenate([b.bins for b in blocks], 1), y, draw, np.concatenate(codes), score)


def team_cores(spark: SparkSession) -> tuple[int, bool]:
    """Cores that a long task may have: those of an executor, and whether they are to be asked for (a local master has no executors)."""
    sc = spark.sparkContext
    if sc.master.startswith("local-cluster"):
        return int(sc.master.split("[")[1].split(",")[1]), True
    if sc.master.startswith("local"):
        return sc.defaultParallelism, False
    own = int(sc.getConf().get("spark.executor.cores", "1"))
    fixed = sc.getConf().get("spark.dynamicAllocation.enabled", "false") != "true"
    return (own, True) if fixed and own > 1 else (1, False)


def fit_team(known: DataFrame, features: list[str], objective: str, n: int, base: float, grid: float, shape: Shape, rounds: int,
             rate: float, seed: int, share: float, columns: float) -> Boosted:
    """A fit by one task over all blocks, a process for each of its cores: rounds need no jobs."""
    edges = exact_edges(known, len(features), n)
    table, path, _ = packed(known, len(features), objective, n, base, edges)
    cores, asked = team_cores(known.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["part"])
        block = joined([Block.of(row) for row in found])
        del found
        rows = TeamRows(block, TaskContext.get().cpus() if asked else cores, objective, grid, seed, share)
        try:
            yield pa.RecordBatch.from_pylist([{"trees": boost(rows, features, base, edges, shape, rounds, rate, seed, columns).to_json()}])
        finally:
            rows.close()

    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build if asked else None
    [[model]] = table.coalesce(1).mapInArrow(fit, "trees string", profile=profile).collect()
    discard_path(known.sparkSession, path)
    return Boosted.from_json(model)


def fit_whole(train: DataFrame, features: Sequence[str], target: str, objective: str, keys: Sequence[str], rounds: int,
              depth: int, rate: float, **options) -> Boosted:
    """Fit one model on every row of ``train``; see ``fit_many``."""
    return fit_many(train, features, {"model": (target, objective)}, keys, rounds, depth, rate, **options)["model"]


def sampled(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest key hash, for a caller who wants a bounded fit."""
    return df.withColumn("_draw", md5_key("fit", *keys)).orderBy("_draw", *keys).limit(rows).drop("_draw")


def scored(model: Boosted, link: str = "raw") -> Column:
    """The model's value for every row, from its feature columns."""
    @F.pandas_udf("double")
    def run(columns: pd.DataFrame) -> pd.Series:
        raw = model.raw(columns.to_numpy(float, na_value=np.nan))
        return pd.Series(1 / (1 + np.exp(-raw)) if link == "logistic" else raw)

    return run(F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)]))


def save_models(spark: SparkSession, models: dict[str, Boosted], path: str) -> None:
    spark.createDataFrame([(k, m.to_json()) for k, m in models.items()], "model string, trees string") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str, what: str) -> dict[str, Boosted]:
    if not path_exists(spark, path):
        raise RuntimeError(f"no {what} model saved at {path}")
    return {r["model"]: Boosted.from_json(r["trees"]) for r in spark.read.parquet(path).collect()}
