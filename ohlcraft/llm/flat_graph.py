"""Near-duplicate embeddings by range search over a robust-pruned flat graph.

1. Identical vectors form a class; its least id stands for it.
2. A tree of centroids, fitted node by node on bounded samples, deepens with the input until a leaf
   (a shard) holds about SHARD vectors. A class is indexed in its INDEXED nearest shards, the overlap, and searches its
   SEARCHED nearest ones: fixed numbers, however many shards there are. Only where vectors crowd, so that several
   centroids lie within TIGHT of a vector, does it search all of those, as its links may be in any.
   A shard that stays over CAP is dealt out in blocks by hash, all of which are searched.
3. Each block builds a flat graph: a node keeps those of its nearest block members that no kept one
   is clearly nearer to (robust pruning), and gets the reverse edges. The adjacency lists of a node
   from all its blocks are united.
4. Every class searches blocks greedily from the medoid (and from itself, where it is indexed) with a
   beam, then expands every node found within the range or just outside it, until nothing new
   comes up. What is found is checked in double precision.
5. A link counts in the nearest of the found class's shards that the query searches; each task sends on only a
   spanning forest of its links, and components are joined by star contraction.

A task holds one block, CAP vectors, and a batch of its queries; a block with many queries is dealt out to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, remove
from .components import connected_components, spanning_forest

MIN_COSINE = 0.95
#: Vectors of a tree node that its centroids are fitted on at most; every vector is indexed.
SAMPLE = 20_000
#: Children of a tree node at most.
FAN = 256
SHARD = 1024
CAP = 4096
#: Queries of a block that one task answers.
SLICE = 16_384
INDEXED, SEARCHED = 2, 6
TIGHT = 0.75
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
BEAM = 12
#: Nodes this far under the range are still expanded.
SLACK = 0.05
_QUERIES = 256


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows; deterministic."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, similarity) of the SEARCHED nearest centroids of each row, and of all within TIGHT."""
    sims = x @ centroids.T
    width = min(SEARCHED, len(centroids))
    least = -np.partition(-sims, width - 1, axis=1)[:, width - 1]
    row, to = np.nonzero(sims >= np.minimum(least, TIGHT)[:, None])
    return row, to, sims[row, to]


_ROUTES = "rep long, node long, sim double"


def _from_root(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, v) -> (rep, node, sim) under the root; its child c is node c + 1."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            row, to, sim = _nearest(_unit(_matrix(part.column(1), centroids.shape[1])), centroids)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(to + 1), pa.array(sim)], ["rep", "node", "sim"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, k, rep, v), a bounded sample a node -> (node, v): a node's centroids in one array."""
    for t in _groups(batches, 1):
        x = _matrix(t.column(3).combine_chunks(), len(t.column(3)[0]))
        c = fit_centroids(_unit(x), min(t.column(1)[0].as_py(), len(x)))
        yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().slice(0, 1), pa.array([c.ravel().tolist()], pa.list_(pa.float64()))], ["node", "v"])


def _descend(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, part, rep, v), the node's centroids first under the null rep -> (rep, node, sim) of its children."""
    centroids = np.empty((0, dim))
    for b in batches:
        node = b.column(0).to_numpy()
        marks = np.flatnonzero(b.column(2).is_null().to_numpy(zero_copy_only=False)).tolist()
        for lo, hi in zip([0, *marks], [*marks, b.num_rows], strict=True):
            if lo in marks:
                centroids = np.array(b.column(3)[lo].as_py()).reshape(-1, dim)
                lo += 1
            for at in range(lo, hi, 4096):
                part = b.slice(at, min(4096, hi - at))
                row, to, sim = _nearest(_unit(_matrix(part.column(3), dim)), centroids)
                yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(row)), pa.array(node[at : at + part.num_rows][row] * (FAN + 1) + to + 1), pa.array(sim)], ["rep", "node", "sim"])


def _kept_routes(routes: DataFrame) -> DataFrame:
    """(rep, nodes): the SEARCHED nearest nodes of each class and all within TIGHT, nearest first."""
    found = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("node").alias("node"))))  # few a class: SEARCHED ** 2, or its crowd's shards
    r = routes.groupBy("rep").agg(found.alias("f"))
    r = r.select("rep", F.expr(f"filter(f, (x, i) -> i < {SEARCHED} OR x.far <= -{TIGHT})").alias("f"))
    return r


def _tree_routes(classes: DataFrame, total: int, dim: int) -> DataFrame:
    """(rep, nodes) of every class, from a tree as deep as ``total`` asks for."""
    sample = classes.orderBy(F.xxhash64(F.lit(11), "rep"), "rep").limit(SAMPLE).select("v").toArrow()
    x = _unit(_matrix(sample.column(0).combine_chunks(), dim))
    centroids = fit_centroids(x, max(1, min(FAN, len(x), -(-total // SHARD))))
    found = _kept_routes(classes.select("rep", "v").mapInArrow(partial(_from_root, centroids), _ROUTES))
    found, path = materialize(found, "graph-routes")
    reach = FAN * SHARD
    while reach < total * FAN:  # a level more than evenly filled nodes would need
        one = found.select("rep", F.explode("f").alias("f")).select("rep", F.col("f.node").alias("node"), (-F.col("f.far")).alias("sim"))
        first = found.select(F.explode(F.slice("f", 1, INDEXED)).alias("f")).groupBy(F.col("f.node").alias("node")).count()
        big = first.where(F.col("count") > CAP).select("node", F.least(F.lit(FAN), F.ceil(F.col("count") / (INDEXED * SHARD))).cast("int").alias("k"), F.ceil(F.col("count") / SAMPLE).cast("int").alias("parts"))
        big, big_path = materialize(big, "graph-big")
        if not big.limit(1).count():
            remove(classes.sparkSession, big_path)
            break
        inside = one.join(big, "node").join(classes.select("rep", "v"), "rep")
        inside, in_path = materialize(inside.select("node", "k", "parts", "rep", "v"), "graph-inside")
        nth = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64(F.lit(13), "rep"), "rep"))
        drawn = inside.withColumn("nth", nth).where(F.col("nth") <= F.least(F.lit(SAMPLE), 64 * F.col("k"))).select("node", "k", "rep", "v")
        fitted = drawn.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_fit, "node long, v array<double>")
        heads = fitted.join(big, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("rep"), "v")
        rows = inside.select("node", F.pmod(F.xxhash64(F.lit(14), "rep"), F.col("parts")).cast("int").alias("part"), "rep", "v")
        below = heads.unionByName(rows).repartition("node", "part").sortWithinPartitions("node", "part", F.col("rep").asc_nulls_first())
        rest = one.join(big.select("node"), "node", "left_anti").select("rep", "node", "sim")
        after, new = materialize(_kept_routes(rest.unionByName(below.mapInArrow(partial(_descend, dim), _ROUTES))), "graph-routes")
        for old in (path, in_path, big_path):
            remove(classes.sparkSession, old)
        found, path = after, new
        reach *= FAN
    return found.select("rep", F.col("f.node").alias("nodes"))


def prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Robust pruning: of each node's neighbours in order of nearness, those not ALPHA times nearer to a kept one.

    ``near`` and ``sims`` are nodes x candidates, nearest first; the result has -1 where none is kept.
    """
    out = np.full((len(near), DEGREE), -1)
    for lo in range(0, len(near), 128):
        idx, s = near[lo : lo + 128], sims[lo : lo + 128]
        v = x[idx]
        d_node = np.maximum(2 - 2 * s, 0)
        d_pair = np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0)
        alive, kept = idx >= 0, np.zeros(len(idx), int)
        rows = np.arange(len(idx))
        for j in range(idx.shape[1]):
            take = alive[:, j] & (kept < DEGREE)
            if not take.any():
                continue
            r = rows[take]
            out[lo + r, kept[take]] = idx[take, j]
            kept[take] += 1
            alive[take] &= ALPHA * ALPHA * d_pair[take, j] > d_node[take]
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    """Edges (2 x m) of the flat graph over unit rows: pruned neighbours and their reverse edges."""
    n, k = len(x), min(CANDIDATES, len(x) - 1)
    if k < 1:
        return np.empty((2, 0), int)
    near, sims = np.empty((n, k), int), np.empty((n, k), x.dtype)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        val = np.take_along_axis(s, top, 1)
        order = np.argsort(-val, axis=1, kind="stable")
        near[lo : lo + 512], sims[lo : lo + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(val, order, 1)
    kept = prune(x, near, sims)
    a, j = np.nonzero(kept >= 0)
    b = kept[a, j]
    step = np.arange(n)  # a ring keeps the graph in one piece
    return np.stack([np.concatenate([a, b, step]), np.concatenate([b, a, (step + 1) % n])])


def _adjacency(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, neighbours) of distinct directed edges."""
    code = np.unique(edges[0] * n + edges[1])
    a, b = code // n, code % n
    a, b = a[a != b], b[a != b]
    return np.searchsorted(a, np.arange(n + 1)), b


def _neighbours(offsets: np.ndarray, targets: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in nodes, neighbour) of all neighbours of the nodes."""
    n = offsets[nodes + 1] - offsets[nodes]
    own = np.repeat(np.arange(len(nodes)), n)
    first = np.repeat(offsets[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return own, targets[first + np.arange(len(own))]


def range_search(x: np.ndarray, offsets: np.ndarray, targets: np.ndarray, entry: int, q: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with similarity of at least ``bound``, for a block of queries together.

    A beam search from the entry, and from the query's ``own`` node where it has one (else -1), finds the nearest region; then
    all nodes seen within the range, or SLACK outside it, are expanded until no new one comes up.
    """
    nq, n, width = len(q), len(x), min(BEAM, len(x))
    seen = np.full((nq, n), np.nan, np.float32)  # similarity of what has been looked at
    seen_flat, claim = seen.reshape(-1), np.empty(nq * n, np.int32)
    expanded = np.zeros((nq, n), bool)
    seen[:, entry] = q @ x[entry]
    beam = np.full((nq, width), -1)
    score = np.full((nq, width), -np.inf, np.float32)
    beam[:, 0], score[:, 0] = entry, seen[:, entry]
    self_ = np.flatnonzero((own >= 0) & (own != entry))
    if width > 1:
        seen[self_, own[self_]] = np.einsum("ij,ij->i", q[self_], x[own[self_]])
        beam[self_, 1], score[self_, 1] = own[self_], seen[self_, own[self_]]

    def look(qi: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The neighbours of (query, node) pairs that weren't looked at, with their similarities."""
        expanded[qi, node] = True
        of, to = _neighbours(offsets, targets, node)
        who = qi[of]
        code = who * n + to
        code = code[np.isnan(seen_flat[code])]
        order = np.arange(len(code), dtype=np.int32)
        claim[code] = order  # of equal pairs the last one stays
        code = code[claim[code] == order]
        who, to = code // n, code % n
        s = np.einsum("ij,ij->i", q[who], x[to])
        seen_flat[code] = s
        return who, to, s

    while True:
        open_ = (beam >= 0) & ~expanded[np.arange(nq)[:, None], beam]
        some = open_.any(axis=1)
        if not some.any():
            break
        qi = np.flatnonzero(some)
        j = np.where(open_[qi], score[qi], -np.inf).argmax(axis=1)
        who, to, s = look(qi, beam[qi, j])
        if not len(who):
            continue
        count = np.bincount(who, minlength=nq)
        room = np.full((nq, count.max()), -1)
        mark = np.full((nq, count.max()), -np.inf, np.float32)
        at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        room[who, at], mark[who, at] = to, s
        ids, vals = np.concatenate([beam, room], axis=1), np.concatenate([score, mark], axis=1)
        top = np.argpartition(-vals, width - 1, axis=1)[:, :width]
        beam, score = np.take_along_axis(ids, top, 1), np.take_along_axis(vals, top, 1)
    with np.errstate(invalid="ignore"):
        qi, node = np.nonzero((seen >= bound - SLACK) & ~expanded)
        while len(qi):
            who, to, s = look(qi, node)
            more = (s >= bound - SLACK) & ~expanded[who, to]
            qi, node = who[more], to[more]
        return np.nonzero(seen >= bound)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows with the same first ``keys`` columns, from sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)])
        cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            key = tuple(cols[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _build(dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, block, rep, v) -> (rep, adj): a node's neighbours in one block."""
    for t in _groups(batches, 2):
        t = t.combine_chunks()
        reps = t.column(2).to_numpy()
        x = _unit(_matrix(t.column(3).combine_chunks(), dim)).astype(np.float32)
        offsets, targets = _adjacency(build_graph(x), len(reps))
        adj = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(reps[targets]))
        yield pa.RecordBatch.from_arrays([pa.array(reps), adj], ["rep", "adj"])


class _Block:
    """One block's index, and the links of the queries that come by."""

    def __init__(self, shard: int, t: pa.Table, dim: int):
        t = t.combine_chunks()
        self.shard, self.ids, self.n = shard, t.column(4).to_numpy(), t.column(5).to_numpy()
        lists, routes = t.column(7).combine_chunks(), t.column(8).combine_chunks()
        self.first = routes.flatten().to_numpy()[routes.offsets.to_numpy()[:-1] - routes.offsets[0].as_py()]
        self.x = _unit(_matrix(t.column(6).combine_chunks(), dim))
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        a, at = np.repeat(np.arange(len(self.ids)), size), np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        here = self.ids[at] == flat  # united lists name members of other blocks too
        self.offsets, self.targets = _adjacency(np.stack([a[here], at[here]]), len(self.ids))
        self.x32 = self.x.astype(np.float32)
        self.entry = int((self.x @ self.x.mean(axis=0)).argmax())
        self.forest = (np.empty(0, np.int64), np.empty(0, np.int64))

    def search(self, b: pa.RecordBatch, dim: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(class, links) of the queries with links that count here; their forest is kept."""
        reps, q = b.column(4).to_numpy(), _unit(_matrix(b.column(6), dim))
        at = np.minimum(np.searchsorted(self.ids, reps), len(self.ids) - 1)
        own = np.where(self.ids[at] == reps, at, -1)
        qi, node = range_search(self.x32, self.offsets, self.targets, self.entry, q.astype(np.float32), own, min_cosine - 1e-4)
        keep = reps[qi] != self.ids[node]
        qi, node = qi[keep], node[keep]
        keep = np.einsum("ij,ij->i", q[qi], self.x[node]) >= min_cosine  # double precision
        qi, node = qi[keep], node[keep]
        # a class is indexed in two shards: the second counts only for queries that don't search the first
        routes = b.column(8)
        flat, ends = routes.flatten().to_numpy(), routes.offsets.to_numpy() - routes.offsets[0].as_py()
        shards, home = np.unique(flat), self.first[node]
        searched = np.sort(np.repeat(np.arange(len(reps)), np.diff(ends)) * len(shards) + np.searchsorted(shards, flat))
        to = np.minimum(np.searchsorted(shards, home), len(shards) - 1)
        code = qi * len(shards) + to
        at = np.minimum(np.searchsorted(searched, code), len(searched) - 1)
        counts = (home == self.shard) | (shards[to] != home) | (searched[at] != code)
        links = np.bincount(qi[counts], self.n[node[counts]], len(reps)).astype(np.int64)
        self.forest = spanning_forest(np.concatenate([self.forest[0], reps[qi]]), np.concatenate([self.forest[1], self.ids[node]]))
        some = links > 0
        return reps[some], links[some]


def _search(dim: int, min_cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, block, slice, is_query, rep, n, v, adj, nodes) -> (kind, a, b).

    kind 0: class a has links to b vectors that count here; kind 1: an edge of the links' forest. The index of a
    block comes first and is held; its queries stream past.
    """
    names = ["kind", "a", "b"]
    block: _Block | None = None
    held: list[pa.RecordBatch] = []
    last = None

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names)

    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            key, is_query = tuple(cols[:3, lo].tolist()), cols[3, lo]
            if key != last:
                if block is not None:
                    yield out(1, *block.forest)
                block, held, last = None, [], key
            if not is_query:
                held.append(b.slice(lo, hi - lo))
                continue
            if held:
                block, held = _Block(key[0], pa.Table.from_batches(held), dim), []
            if block is not None:
                for at in range(lo, hi, _QUERIES):
                    yield out(0, *block.search(b.slice(at, min(_QUERIES, hi - at)), dim, min_cosine))
    if block is not None:
        yield out(1, *block.forest)


def _links(classes: DataFrame, dim: int, min_cosine: float) -> DataFrame:
    """(kind, a, b) of :func:`_search` for the classes (rep, n, v) of one dimension."""
    routes = _tree_routes(classes, classes.count(), dim)
    routed, _ = materialize(classes.join(routes.hint("merge"), "rep"), "graph-routed")
    indexed, asked = F.explode(F.slice("nodes", 1, INDEXED)).alias("node"), F.explode("nodes").alias("node")
    sizes = routed.select(indexed).groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(routed.select(asked).groupBy("node").agg(F.count(F.lit(1)).alias("q")), "node")
    plan, _ = materialize(sizes.select("node", F.ceil(F.col("n") / CAP).cast("int").alias("blocks"), F.ceil(F.col("q") / SLICE).cast("int").alias("slices")), "graph-plan")
    # the plan has a row a shard: the planner broadcasts it by its written size, or sorts and merges
    member = routed.select("rep", "n", "v", "nodes", indexed).join(plan, "node").withColumn("block", F.pmod(F.xxhash64(F.lit(12), "rep"), F.col("blocks")).cast("int"))
    built = member.select("node", "block", "rep", "v").repartition("node", "block").sortWithinPartitions("node", "block", "rep")
    graph = built.mapInArrow(partial(_build, dim), "rep long, adj array<long>")
    united = graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))  # a list from each of INDEXED shards
    united, _ = materialize(united, "graph-lists")
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    index = member.join(united.hint("merge"), "rep").select("node", "block", each, F.lit(False).alias("is_query"), "rep", "n", "v", "adj", "nodes")
    query = routed.select("rep", "n", "v", "nodes", asked).join(plan, "node").withColumn("slice", F.pmod(F.xxhash64(F.lit(15), "rep"), F.col("slices")).cast("int"))
    query = query.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "slice", F.lit(True).alias("is_query"), "rep", "n", "v", F.expr("cast(array() AS array<bigint>)").alias("adj"), "nodes")
    both = index.unionByName(query).repartition("node", "block", "slice").sortWithinPartitions("node", "block", "slice", "is_query", "rep")
    return both.mapInArrow(partial(_search, dim, min_cosine), "kind int, a long, b long")


def _fine(v):
    """Whether a vector can link: no null, only finite components, not all zero."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    n_links counts the other rows with a cosine of at least ``min_cosine`` (identical ones
    included), component_id is the least id reachable over links, kept tells whether that is the row's own.
    Null, empty and zero vectors, those with null or non-finite components, and vectors of different
    lengths link with nothing. Rows with a null id link with nothing and have null component and kept. Other
    columns aren't looked at; an empty table gives an empty result. Components are taken as doubles.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.col("id").isNotNull() & _fine(F.col("v")))
    rows = rows.select("id", "ok", F.when(F.col("ok"), F.col("v")).alias("v"), F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v", F.size("v")).alias("h2"))
    # 128 bits of hash stand for the vector, so that the vectors themselves move once
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes, _ = materialize(classes, "graph-classes")
    out = spark.createDataFrame([], "kind int, a long, b long")
    for r in classes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # a row a length of vectors
        out = out.unionByName(_links(classes.where(F.size("v") == r["dim"]).select("rep", "n", "v"), r["dim"], min_cosine))
    out, _ = materialize(out, "graph-links")
    counts = out.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    labels = connected_components(out.where("kind = 1").select("a", "b")).withColumnRenamed("id", "rep")
    done = classes.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(labels, "rep", "left")
    done = done.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    done, _ = materialize(done, "graph-done")
    j = rows.select("id", "ok", "h1", "h2").join(done, ["h1", "h2"], "left")
    j = j.select("id", F.when(F.col("ok"), F.col("links")).otherwise(0).alias("n_links"), F.when(F.col("ok"), F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return j.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: Rows that the audit compares with all others.
AUDITED = 1000


def audit_recall(vectors: DataFrame, found: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row (audited, links, missed, surplus, recall): how the counts of ``found`` compare with brute force.

    Audited are the first AUDITED rows, by a hash, of those with an id divisible by ``every``; each is compared with all rows in one pass.
    missed and surplus are summed apart, so that a false link can't make up for a lost one. Vectors that can't link, of
    whatever length, count as rows without links; without links the recall is 1.
    """
    spark = vectors.sparkSession
    ok = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _fine(F.col("v")))
    drawn = ok.where(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "id").limit(AUDITED).collect()  # AUDITED rows
    ids = [r["id"] for r in drawn]
    by_dim = {d: (np.array([i for i, r in enumerate(drawn) if len(r["v"]) == d]), _unit(np.array([r["v"] for r in drawn if len(r["v"]) == d]))) for d in {len(r["v"]) for r in drawn}}

    def scan(batches):
        n = np.zeros(len(ids), np.int64)
        for b in batches:
            size = np.diff(b.column(0).offsets.to_numpy())
            for d, (at, q) in by_dim.items():
                some = np.flatnonzero(size == d)
                for lo in range(0, len(some), 1000):
                    n[at] += (_unit(_matrix(b.column(0).take(pa.array(some[lo : lo + 1000])), d)) @ q.T >= min_cosine - 1e-12).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n)], ["id", "n"])

    true = ok.select("v").mapInArrow(scan, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("true")) if ids else spark.createDataFrame([], "id long, true long")
    got = found.select(F.col(id_col).cast("long").alias("id"), "n_links").groupBy("id").agg(F.min("n_links").alias("n_links"))
    j = true.join(got, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    total = F.coalesce(F.sum("true"), F.lit(0))
    missed = F.coalesce(F.sum(F.greatest(F.col("true") - F.col("n_links"), F.lit(0))), F.lit(0))
    one = j.agg(F.count(F.lit(1)).alias("audited"), total.alias("links"), missed.alias("missed"), F.coalesce(F.sum(F.greatest(F.col("n_links") - F.col("true"), F.lit(0))), F.lit(0)).alias("surplus"))
    return one.withColumn("recall", F.when(F.col("links") > 0, 1 - F.col("missed") / F.col("links")).otherwise(F.lit(1.0)))


ORACLE = """
WITH RECURSIVE fine AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM fine a JOIN fine b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
