"""Exact top-k search for inner products with paged M-trees.

Inner products become distances by one more component: with M2 the largest squared norm of all vectors, a
vector x gets sqrt(M2 - |x|^2) and a query 0; then d(q, x)^2 = |q|^2 + M2 - 2 q.x, so the nearest vectors
are those of the highest products. The components are integers and the bounds leave a margin for rounding,
so the result is exact: a bound only ever drops vectors whose product is lower than that of k others.

Upper nodes. A bounded sample of the vectors gives the upper levels of the tree, whose leaves are pages. Each
vector goes down to the nearest child from the root to a page; every node's covering radius is the largest
distance of the vectors that went through it. A page of over PAGE vectors is cut into rings by distance from its
routing point, and a ring whose vectors lie at one distance by a hash of the id, so a vector that a third of the
rows have fills no task. Each query first scores the sample: its k-th best is a lower bound of the result. The
query then goes down the upper nodes, past those that stored parent distances or radii put beyond that bound, and
visits the rings that are left.

In a page's part the task bulk-loads the lower levels: nodes hold entries with a covering radius and the distance
to their parent. The search is best-first; an entry is dropped without computing its distance if the stored
distances and the triangle inequality already put its ball behind the k-th best so far. A part is moved once for
each QUERIES queries that visit it, and its tree is built once for them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

K = 10
#: Rows of the sample and pages at most, which bound what reaches the driver; a page for each PER_PAGE rows.
SAMPLE, PAGES, PER_PAGE = 2048, 256, 2048
#: Vectors of a part of a page, rings of a page at most, and queries that visit a part together.
PART, RINGS, QUERIES = 4096, 32, 16_384
LEAF, FANOUT = 512, 12
SCALE = 1024


class MTree:
    """An M-tree over the rows of an array, bulk-loaded from the top. `order` lists the rows so that each leaf is one run of it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.least, self.fanout = leaf, fanout
        #: of each node: routing point, radius, and children's distances to it; children of a leaf are a run of places
        self.routing, self.radius, self.to_parent, self.children, self.leaf = [], [], [], [], []
        self._order: list[np.ndarray] = []
        self._placed = 0
        self._node(points, np.arange(len(points)), points[0])
        self.order = np.concatenate(self._order)
        self.points_of = {n: np.array([self.routing[k] for k in kids]) for n, kids in enumerate(self.children) if not self.leaf[n]}
        self.radii_of = {n: np.array([self.radius[k] for k in kids]) for n, kids in enumerate(self.children) if not self.leaf[n]}

    def _node(self, points: np.ndarray, rows: np.ndarray, routing: np.ndarray) -> int:
        me, d = len(self.routing), _distances(points[rows], routing)
        self.routing.append(routing)
        self.radius.append(float(d.max()))
        self.leaf.append(len(rows) <= self.least or d.max() == 0)
        self.to_parent.append(d)
        self.children.append((self._placed, self._placed + len(rows)))
        if self.leaf[me]:
            self._order.append(rows)
            self._placed += len(rows)
            return me
        # children around rows that lie far from each other
        own, at = points[rows], int(d.argmax())
        nearest, owner, chosen = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64), []
        for c in range(min(self.fanout, max(2, 2 * len(rows) // self.least))):
            chosen.append(own[at])
            to = _distances(own, own[at])
            closer = to < nearest
            nearest[closer], owner[closer] = to[closer], c
            at = int(nearest.argmax())
            if nearest[at] == 0:
                break
        kids = [self._node(points, rows[owner == c], p) for c, p in enumerate(chosen) if (owner == c).any()]
        self.children[me] = np.array(kids)
        self.to_parent[me] = _distances(np.array([self.routing[k] for k in kids]), routing)
        return me

    def search(self, q: np.ndarray, take, bound: float) -> None:
        """Hands runs of `order` that can be nearer than the bound to take(places) -> bound; nearest nodes first."""
        first = float(_distances(self.routing[0][None], q)[0])
        queue = [(max(0.0, first - self.radius[0]), 0, first)]
        while queue:
            least, node, to_routing = heapq.heappop(queue)
            if least > bound:
                break
            # |d(q, parent) - d(child, parent)| is no more than d(q, child)
            gap = np.abs(to_routing - self.to_parent[node])
            if self.leaf[node]:
                start, stop = self.children[node]
                near = gap <= bound
                bound = take(slice(start, stop) if near.all() else start + np.flatnonzero(near))
                continue
            radius = self.radii_of[node]
            near = np.flatnonzero(gap - radius <= bound)
            d = _distances(self.points_of[node][near], q)
            for k, dk, r in zip(self.children[node][near].tolist(), d.tolist(), radius[near].tolist(), strict=True):
                if dk - r <= bound:
                    heapq.heappush(queue, (max(0.0, dk - r), k, dk))


class Upper:
    """The upper levels: an M-tree over a sample, whose leaves are pages of all vectors."""

    def __init__(self, sample: np.ndarray, pages: int):
        self.tree = MTree(sample, max(1, -(-len(sample) // pages)))
        self.path: dict[int, list[int]] = {}  # of each page: the nodes from the root to it
        stack = [(0, [0])]
        while stack:
            node, path = stack.pop()
            if self.tree.leaf[node]:
                self.path[node] = path
            else:
                stack += [(int(k), [*path, int(k)]) for k in self.tree.children[node]]
        self.depth = max(map(len, self.path.values()))
        self.points = np.array(self.tree.routing)

    def pages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(page, distances) of each row: distances to the nodes that it goes through, infinite below the page."""
        page, far = np.zeros(len(x), dtype=np.int64), np.full((len(x), self.depth), np.inf)
        far[:, 0] = _distances(x, self.points[0])
        stack = [(0, 0, np.arange(len(x)))]
        while stack:
            node, level, rows = stack.pop()
            if self.tree.leaf[node]:
                page[rows] = node
                continue
            kids = self.tree.children[node]
            d = np.array([_distances(x[rows], p) for p in self.tree.points_of[node]])
            best = d.argmin(axis=0)
            far[rows, level + 1] = d[best, np.arange(len(rows))]
            stack += [(int(k), level + 1, rows[best == c]) for c, k in enumerate(kids) if (best == c).any()]
        return page, far

    def cover(self, radii: dict[int, list[float]]) -> None:
        """Sets the covering radii from the largest distances of each page's vectors to the nodes of its path. Nodes without vectors cover nothing."""
        radius = np.full(len(self.points), -np.inf)
        for page, far in radii.items():
            for node, d in zip(self.path[page], far, strict=False):
                radius[node] = max(radius[node], d)
        self.tree.radius = radius.tolist()
        self.tree.radii_of = {n: radius[self.tree.children[n]] for n in self.tree.radii_of}

    def reached(self, q: np.ndarray, bound: float) -> list[tuple[int, float]]:
        """(page, distance) of the pages whose ball comes within the bound of q."""
        out, stack = [], [(0, float(_distances(self.points[:1], q)[0]))]
        while stack:
            node, dq = stack.pop()
            if dq - self.tree.radius[node] > bound:
                continue
            if self.tree.leaf[node]:
                out.append((node, dq))
                continue
            near = np.flatnonzero(np.abs(dq - self.tree.to_parent[node]) - self.tree.radii_of[node] <= bound)
            d = _distances(self.tree.points_of[node][near], q)
            stack += [(int(k), float(dk)) for k, dk in zip(self.tree.children[node][near], d, strict=True)]
        return out


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where they hold them exactly."""
    big = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * rows.shape[1]
    return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if big < 2**53 else (rows * q).sum(axis=1)


def _lift(rows: np.ndarray, m2: float) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, m2 - np.einsum("ij,ij->i", x, x)))])


def _reach(q2: float, m2: float, score: float) -> float:
    """The distance of a product, with a margin for rounding."""
    return math.sqrt(max(0.0, q2 + m2 - 2 * score)) + 1e-6 * math.sqrt(q2 + m2) + 1e-9


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _search_page(left: pd.DataFrame, right: pd.DataFrame, k: int, width: int, m2: float) -> pd.DataFrame:
    """The k best of a part of a page for each of the queries that visit it."""
    out: list[tuple] = []
    if len(left) and len(right):
        rows = _matrix(left["v"].tolist(), width)
        tree = MTree(_lift(rows, m2))
        rows, ids = rows[tree.order], left["vec_id"].to_numpy(dtype=np.int64)[tree.order]
        plain, top = rows.astype(np.float64), float(np.abs(rows).max(initial=0))
        for n, qid, v, floor in zip(right["q"].tolist(), right["query_id"].tolist(), right["v"].tolist(), right["floor"].tolist(), strict=True):
            q = _matrix([v], width)[0]
            point = q.astype(np.float64)
            q2, exact = float(point @ point), top * float(np.abs(q).max(initial=0)) * width < 2**53  # so doubles hold the sums
            held_s, held_i = np.zeros(0, np.int64), np.zeros(0, np.int64)

            def take(places, q=q, point=point, q2=q2, exact=exact, qid=qid, floor=floor) -> float:
                nonlocal held_s, held_i
                s, i = (plain[places] @ point if exact else (rows[places] * q).sum(axis=1)), ids[places]
                least = max(floor, held_s[-1]) if len(held_s) == k else floor
                good = (s >= least) & (i != qid)
                s, i = np.concatenate([held_s, s[good].astype(np.int64)]), np.concatenate([held_i, i[good]])
                at = _best(s, i, k)
                held_s, held_i = s[at], i[at]
                least = max(floor, float(held_s[-1])) if len(held_s) == k else floor
                return _reach(q2, m2, least) if least > -math.inf else math.inf

            tree.search(np.append(point, 0.0), take, _reach(q2, m2, floor) if floor > -math.inf else math.inf)
            out += [(n, qid, int(i), int(s)) for i, s in zip(held_i, held_s, strict=True)]
    return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"]).astype("int64")


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, n2) of the rows that take part: no null vector or id, no null or non-finite component."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    whole = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.filter(whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    return rows.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def top_k(vectors: DataFrame, every: int = 100, k: int = K, part: int = PART, pages: int = PAGES, per_page: int = PER_PAGE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the highest integer inner product of each query.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the query's
    own id. Ties go to the smaller id; fewer candidates than k are all returned. Vectors that are null or hold
    a null or non-finite component take no part. Shorter vectors count as filled up with zeros, and very long
    ones are taken whole. Repeated rows of an id are candidates one by one, and queries one by one: each has its
    own k rows, of ranks from 1. Other columns, whatever their names, are left out; an empty table has an empty
    result.
    """
    rows = checkpointed(quantised(vectors, vec_id, embedding))
    most = rows.agg(F.max("n2"), F.max(F.size("v")), F.count("*")).first()
    if most[0] is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    m2, width = float(most[0]), max(1, int(most[1]))
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    s_ids, s_rows = np.array([r.vec_id for r in sample]), _matrix([r.v for r in sample], width)
    upper = Upper(_lift(s_rows, m2), min(pages, -(-most[2] // per_page)))

    def to_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            page, far = upper.pages(_lift(_matrix(pdf["v"].tolist(), width), m2))
            own = far[np.arange(len(far)), np.isfinite(far).sum(axis=1) - 1]
            yield pdf.drop(columns="n2").assign(p=page, far=list(far), d=own)

    dealt = checkpointed(rows.mapInPandas(to_pages, "vec_id long, v array<long>, p long, far array<double>, d double"))
    far = [F.max(F.col("far")[i]).alias(f"far{i}") for i in range(upper.depth)]
    cuts = F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000)
    held = dealt.groupBy("p").agg(F.count("*").alias("n"), cuts.alias("cuts"), *far).collect()  # a row for each page
    upper.cover({r.p: [r[f"far{i}"] for i in range(upper.depth)] for r in held})
    # the inner borders of the rings of each page
    rings = {r.p: sorted({r.cuts[i * RINGS // n - 1] for i in range(1, n)}) for r in held for n in [min(RINGS, -(-r.n // part))]}
    of = F.broadcast(rows.sparkSession.createDataFrame(list(rings.items()), "p long, cuts array<double>"))
    dealt = dealt.join(of, "p").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d"))).cast("long")).select("p", "ring", "vec_id", "v")

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, qid, v in zip(pdf["q"].tolist(), pdf["vec_id"].tolist(), pdf["v"].tolist(), strict=True):
                q = _matrix([v], width)[0]
                scores = np.sort(_products(s_rows, q)[s_ids != qid])
                floor = float(scores[-k]) if len(scores) >= k else -math.inf
                bound = _reach(float((q.astype(np.float64) ** 2).sum()), m2, floor) if floor > -math.inf else math.inf
                visits = []
                for page, d in upper.reached(np.append(q.astype(np.float64), 0.0), bound):
                    borders = [0.0, *rings.get(page, ()), upper.tree.radius[page]]
                    visits += [(page, i) for i in range(len(borders) - 1) if borders[i] - bound <= d <= borders[i + 1] + bound]
                if visits:
                    p, ring = zip(*visits, strict=True)
                    yield pd.DataFrame({"p": p, "ring": ring, "q": n, "query_id": qid, "v": [v] * len(p), "floor": floor})

    asked = checkpointed(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v").withColumn("q", F.monotonically_increasing_id()))
    visits = checkpointed(asked.mapInPandas(to_visits, "p long, ring long, q long, query_id long, v array<long>, floor double"))
    cells = dealt.groupBy("p", "ring").agg(F.ceil(F.count("*") / part).alias("parts")).join(visits.groupBy("p", "ring").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), ["p", "ring"])
    cells = F.broadcast(checkpointed(cells))  # PAGES * RINGS rows at most
    each = dealt.join(cells, ["p", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ask = visits.join(cells, ["p", "ring"]).withColumn("block", F.pmod(F.xxhash64("q"), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keys = ["p", "ring", "part", "block"]
    found = (
        each.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(ask.select(*keys, "q", "query_id", "v", "floor").groupBy(*keys))
        .applyInPandas(lambda a, b: _search_page(a, b, k, width, m2), "q long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_mtree_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
