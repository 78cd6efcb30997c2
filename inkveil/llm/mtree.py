"""Exact nearest or best-scoring vectors by best-first search in paged M-trees.

The vectors are dealt to pages of a bounded number of rows.  Each task builds
the M-tree of its page: every node has a routing vector, the covering radius
of what lies below, and the distance to its parent's routing vector.  A search
keeps nodes in a heap by an upper bound of the score.  The bound follows from
the triangle inequality, in the form for inner products: what lies within
radius r of c scores at most q·c + |q| r.  A child is first bounded by its
parent's score and the stored parent distance, without touching the child's
vector; only if that bound still beats the k-th best is its own score computed.
Rows of a leaf stand by their distance to its routing vector, farthest first, so
one cut leaves out all whose bound is too low.  Scores are computed in integers,
bounds are rounded up, so results are exact: in floats or longs where the sizes
of page and query prove these exact, else in Python's integers.

How much is spared depends on the vectors: groups help, and vectors spread evenly
over many dimensions have bounds that leave nothing out.

A query set meets the pages in blocks: (page, block of queries) is one group of
bounded size, and each gives its best k per query, merged by query.

Edge cases: vectors that are NULL, hold NULL or non-finite components, or have
a NULL id take no part, finite ones of any size do; vectors of another length
than the query's don't meet it; ties go to the smaller id; repeated ids are
separate candidates, and a row is never a candidate of its own id; a query given
twice is answered once, one id with different vectors once for each; an empty
table gives no rows.  Ranks follow the exact score; a score that no long can hold
is returned as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PAGE_ROWS, BLOCK_ROWS = 16_384, 4_096
LEAF, FANOUT = 128, 8
SCALE = 256
RESULT = "query_id long, asked long, vec_id long, score long, beyond string"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
# Beyond this size of a component squares may leave the doubles: such pages are read whole.
VAST = 2.0**400
# Above any score's distance from a long, and so many digits.
OFFSET = 10**700


@dataclass
class Node:
    """A page of the tree; leaves hold rows, inner pages their children and the children's routing data."""

    rows: slice | None  # of a leaf, farthest from the routing vector first
    children: list[Node]
    routing: np.ndarray  # of the children
    radius: np.ndarray
    to_parent: np.ndarray  # of the children, in a leaf of the rows


def split(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Deal rows to the nearest of a few routing rows, far from each other."""
    picked = [int(rng.integers(len(rows)))]
    own = vectors[rows].astype(np.float64)
    nearest = ((own - own[picked[0]]) ** 2).sum(1)
    group = np.zeros(len(rows), np.int64)
    for g in range(1, min(FANOUT, len(rows))):
        far = int(nearest.argmax())
        if not nearest[far]:
            break
        picked.append(far)
        d = ((own - own[far]) ** 2).sum(1)
        group[d < nearest] = g
        nearest = np.minimum(nearest, d)
    parts = [rows[group == g] for g in range(len(picked))]
    return parts if len(parts) > 1 else np.array_split(rows, -(-len(rows) // LEAF))  # equal vectors: any cut will do


def build(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator, center: np.ndarray, order: list[np.ndarray], at: int = 0) -> Node:
    """The tree of some rows; its leaves are ranges of ``order``, from ``at`` on."""
    if len(rows) <= LEAF:
        distance = np.sqrt(((vectors[rows] - center) ** 2).sum(1))
        farthest = np.argsort(-distance, kind="stable")
        order.append(rows[farthest])
        return Node(slice(at, at + len(rows)), [], np.empty(0), np.empty(0), distance[farthest])
    parts = split(vectors, rows, rng)
    routing = np.array([vectors[p].mean(0) for p in parts])
    radius = np.array([np.sqrt(((vectors[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, routing)])
    to_parent = np.sqrt(((routing - center) ** 2).sum(1))
    children = []
    for p, c in zip(parts, routing):
        children.append(build(vectors, p, rng, c, order, at))
        at += len(p)
    return Node(None, children, routing, radius, to_parent)


def whole(parts: np.ndarray) -> np.ndarray:
    """Python's integers of components given in parts of ``SCALE``."""
    large = 2.0**52
    return np.array([int(x) * SCALE if abs(x) >= large else int(x * SCALE) for x in parts.ravel()], object).reshape(parts.shape)


class MTree:
    """The M-tree of one page of vectors, given in parts of ``SCALE`` as ``integers`` makes them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.asarray(vectors, np.float64)[order]
        self.width = max(1, self.vectors.shape[1])
        self.peak = float(np.abs(self.vectors).max(initial=0))
        self.forms: dict[str, np.ndarray] = {}
        self.scored = 0  # rows whose score was computed, over all searches
        every = np.arange(len(ids))
        self.center = np.zeros(self.width)
        self.root = self.all = Node(slice(0, len(ids)), [], np.empty(0), np.empty(0), np.full(len(ids), np.inf))
        if len(ids) and self.peak < VAST:
            self.center = self.vectors.mean(0)
            dealt: list[np.ndarray] = []
            self.root = build(self.vectors, every, np.random.default_rng(1), self.center, dealt)
            place = np.concatenate(dealt)
            self.ids, self.vectors = self.ids[place], self.vectors[place]
            self.longest = float(np.sqrt((self.vectors**2).sum(1).max()))

    def _form(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and query as numbers whose products and sums are exact."""
        top = max(1.0, float(np.abs(query).max(initial=0)) * SCALE)
        size = float(top) * max(1.0, self.peak * SCALE) * self.width if max(top, self.peak) < VAST else np.inf
        if size < 2.0**52:
            kind, make = "float", lambda x: x * SCALE
        elif size < 2.0**62:
            kind, make = "long", lambda x: (x * SCALE).astype(np.int64)
        else:
            kind, make = "whole", whole
        if kind not in self.forms:
            self.forms[kind] = make(self.vectors)
        return self.forms[kind], make(query)

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """The k best ``(score, id)``, ties to the smaller id, without the rows of id ``own``."""
        query = np.asarray(query, np.float64)
        rows, exact_query = self._form(query)
        vast = max(self.peak, float(np.abs(query).max(initial=0))) >= VAST
        # Bounds are of the scores' size: in floats, and so wide that rounding can't cut a row off.
        q = np.zeros(self.width) if vast else query * SCALE * SCALE
        length = np.inf if vast else float(np.sqrt(q @ q)) * (1 + 1e-9)
        slack = np.inf if vast else 1e-9 * (1 + length) * (1 + self.longest) if len(self.ids) else 0.0
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        heap = [(-np.inf, 0, self.all if vast else self.root, float(q @ self.center))]
        tick = 1
        while heap:
            bound, _, node, score = heapq.heappop(heap)
            least = float(best[0][0]) if len(best) == k and not vast else -np.inf
            if -bound + slack < least:
                break
            if node.rows is not None:
                # Farthest first: what lies beyond this place is too near the routing vector to score enough.
                n = len(node.to_parent)
                if least > -np.inf:
                    n = int((score + length * node.to_parent + slack >= least).sum())
                own_rows = slice(node.rows.start, node.rows.start + n)
                ids, scores = self.ids[own_rows], rows[own_rows] @ exact_query
                self.scored += n
                keep = ids != own if own is not None else np.ones(n, bool)
                if len(best) == k:
                    keep &= scores >= best[0][0]
                for s, i in zip(scores[keep].tolist(), ids[keep].tolist()):
                    item = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            far = np.flatnonzero(score + length * (node.to_parent + node.radius) + slack >= least)
            own_scores = node.routing[far] @ q
            bounds = own_scores + length * node.radius[far]
            for b, s, c in zip(bounds.tolist(), own_scores.tolist(), far.tolist()):
                if b + slack >= least:
                    heapq.heappush(heap, (-b, tick, node.children[c], s))
                    tick += 1
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integers(vector: Column) -> Column:
    """floor(256 x) / 256 of each component, as double, which holds it exactly; NULL where the vector can't take part."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )

    def floored(x: Column) -> Column:
        d = x.cast("double")
        # From 2**45 on a double is a multiple of 1/256 itself.
        return F.when(F.abs(d) < F.lit(2.0**45), F.floor(F.lit(float(SCALE)) * d) / F.lit(float(SCALE))).otherwise(d)

    return F.when(usable, F.transform(vector, floored))


def _beyond(score: int) -> str | None:
    """How far a score lies from the nearest long, as text in numeric order; None if it is a long."""
    near = min(MOST, max(LEAST, score))
    return None if score == near else f"{OFFSET + score - near:0701d}"


def best_of(vectors: DataFrame, queries: DataFrame, k: int, page_rows: int = PAGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best per query; both tables have ``vec_id, v`` (of ``integers``)."""
    queries = queries.dropDuplicates(["vec_id", "v"])
    pages = max(1, -(-vectors.count() // page_rows))
    blocks = max(1, -(-queries.count() // block_rows))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        hashed = F.xxhash64("vec_id", "v")
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.select("vec_id", "v", hashed.alias("asked"), F.pmod(hashed, F.lit(n)).cast("int").alias(own), every.alias(other))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, own in rows.groupby(rows["v"].map(len)):
            ask = asked[asked["v"].map(len) == width]
            tree = MTree(own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy())) if len(ask) else None
            for query, key, vector in zip(ask["vec_id"], ask["asked"], ask["v"]):
                hits = tree.search(vector, k, int(query))
                found += [(query, key, i, min(MOST, max(LEAST, s)), _beyond(s)) for s, i in hits]
        return pd.DataFrame(found, columns=["query_id", "asked", "vec_id", "score", "beyond"])

    left = dealt(vectors, "page", pages, "block", blocks).groupBy("page", "block")
    right = dealt(queries, "block", blocks, "page", pages).groupBy("page", "block")
    found = left.cogroup(right).applyInPandas(search, RESULT)
    # Falling order; the complement of an id grows as the id falls and never overflows.
    exact = F.coalesce("beyond", F.lit(str(OFFSET)))
    item = F.struct("score", exact.alias("beyond"), F.bitwise_not("vec_id").alias("from_id"))
    top = found.groupBy("query_id", "asked").agg(F.slice(F.sort_array(F.collect_list(item), asc=False), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.bitwise_not("hit.from_id").alias("vec_id"), "hit.score"
    )
