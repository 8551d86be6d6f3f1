"""Embedding near-duplicates: exact pairs at a cosine threshold by dual traversal of a cover tree.

On unit vectors cosine >= t means distance <= sqrt(2 - 2 t). There is one tree for each length of vectors. Level i has
radius 2 / 2^i and holds every vector that no leaf above holds:

* nesting: a centre is a centre of all levels below, its own first child, down to its leaf;
* covering: every vector of a node lies within the level's radius of the node's centre;
* separation: children of one node lie farther apart than the level's radius.

A level is built as a table, in rounds: each node's own centre keeps what it covers; of the rest a bounded number of
candidates, taken by hash, becomes a net of new centres in one task, all tasks then send the rest to the nearest new
centre that covers it, and rounds go on until nothing is left. A node is a leaf once all of its vectors must link with
each other, so a single vector is one; no number of vectors makes a leaf. Bounds take the radius that a node's vectors
really have.

The dual traversal walks down pairs of nodes, level by level, as a table as well. A pair of children goes where the
centres are farther apart than both radii and the threshold distance; a pair of leaves is settled where centres and
radii show that all of its vectors link, and other pairs of leaves are compared in double precision. Children of a node,
and vectors of a leaf, are dealt in cells of a bounded number of bytes, and a task gets two cells, one held, one streamed.
Where more than a share of the pairs of two cells can neither go nor be settled, walking on would cost more than it saves:
the vectors below both cells are compared at once.

Equal vectors are one point with a multiplicity. A task returns, per point or leaf, the number of linked vectors, and as
edges only stars over the components it saw, so that a large group of near copies doesn't return all its pairs.

Defined cases: null and empty vectors, zero vectors and vectors with null or non-finite components link with nothing and
are their own component; vectors of different length don't link; finite vectors of any magnitude are scaled before their
norm is taken; repeated rows of one id count as separate vectors of equal content; rows with a null id link like others
and join their neighbours, but name no component; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm.common import connected_components, materialize, release, table, tidy

TOP = 2.0  # radius of level 0: no two unit vectors are farther apart
FLOOR = 2.0**-10  # a radius of which a node is a leaf at any threshold
NET = 8 << 20  # bytes in double precision of the candidates that one task makes centres of in a round
CELL = 4 << 20  # bytes in double precision of the nodes or vectors in a cell
DEALT = 8192  # vectors of a node that one task sends down
DENSE = 1 / 8  # share of pairs of two cells from which on vectors are compared at once
OPEN = 1 << 19  # pairs to walk on with that one task keeps; beyond them the same
SLACK = 1e-6  # rounding allowed for in bounds

Put = Callable[[DataFrame], DataFrame]  # writes a table: materialize, or that and a record of it


def unit(blobs, kind: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision; the largest component is brought to 1 first, so no norm overflows or vanishes."""
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cos))


def net(x: np.ndarray, radius: float, tile: int = 256) -> list[int]:
    """Rows that are centres: each is farther than radius from those before it, and every row is within radius of one."""
    limit = 1 - radius * radius / 2
    kept, centres = [], np.empty_like(x)
    for s in range(0, x.shape[0], tile):
        part = x[s : s + tile]
        free = (part @ centres[: len(kept)].T < limit).all(1)
        inner = part @ part.T >= limit
        for k in np.flatnonzero(free):
            if free[k]:
                centres[len(kept)] = part[k]
                kept.append(s + int(k))
                free &= ~inner[k]
    return kept


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each end to the smallest end of its component, for links (a, b)."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: a.size], at[a.size :]
    low = np.arange(ends.size)
    while True:
        new = low.copy()
        both = np.minimum(low[i], low[j])
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(ends.size)
    return ends[far], ends[low[far]]


def compare(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold; products near the threshold are taken again one by one in a fixed order."""
    for s in range(0, x.shape[0], tile):
        cos = x[s : s + tile] @ y.T
        a, b = np.nonzero(cos >= threshold - 1e-9)
        exact = cos[a, b]
        a = a + s
        if same:
            keep = a < b
            a, b, exact = a[keep], b[keep], exact[keep]
        close = np.abs(exact - threshold) < 1e-9
        exact[close] = (x[a[close]] * y[b[close]]).sum(1)
        keep = exact >= threshold
        if keep.any():
            yield a[keep], b[keep]


def _points(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame, str]:
    """(rows: vec_id, point, or null for what can't link), (points: point, dim, mult, rep, x), element type of x."""
    kind, single = ("<f4", "float") if dict(vectors.dtypes)[vec_col] == "array<float>" else ("<f8", "double")
    zero = F.lit(0).cast(single)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda v: v.cast(single) + zero).alias("v"))  # -0 becomes 0
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("v", lambda v: v != 0)
    rows = rows.withColumn("point", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("v")))
    points = rows.where("point is not null").groupBy("point").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(3)
            flat, at = v.values.to_numpy(zero_copy_only=False).astype(kind), v.offsets.to_numpy()
            blobs = pa.array([flat[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), b.column(1), b.column(2), blobs], names=["point", "dim", "mult", "rep", "x"])

    return materialize(rows.select("vec_id", "point")), materialize(points.mapInArrow(pack, "point long, dim long, mult long, rep long, x binary")), kind


def _sent_down(members: DataFrame, centres: DataFrame, sizes: DataFrame, kind: str, radius: float, put: Put) -> DataFrame:
    """members (point, mult, x, node) with parent (their node), node (the nearest of its centres, null if none is within
    radius) and d. centres: node, id, dim, x; sizes: node, n. A node's members are dealt to as many tasks as they need; its
    centres go to each."""
    deals = sizes.select("node", (F.floor(F.col("n") / DEALT) + 1).alias("deals"))
    dealt = members.join(deals, "node").select("node", F.pmod(F.xxhash64("point", F.lit(7)), F.col("deals")).alias("deal"), F.lit(1).alias("member"), "point", "mult", "x", F.lit(0).cast("long").alias("dim"))
    every = centres.join(deals, "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("member"), F.col("id").alias("point"), F.lit(0).cast("long").alias("mult"), "x", "dim")
    rows = every.unionByName(dealt).repartition("node", "deal").sortWithinPartitions("node", "deal", "member")
    limit = 1 - radius * radius / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, centre = None, [], []  # centres of the group that is read
        for b in batches:
            out = []
            for (node, deal, member), g in b.groupby(["node", "deal", "member"], sort=False):
                if (node, deal) != last:
                    last, ids, centre, dim = (node, deal), [], [], 0
                if member == 0:
                    dim = int(g["dim"].iloc[0])
                    ids += g["point"].tolist()
                    centre.append(unit(g["x"].tolist(), kind, dim))
                else:
                    centre = [np.concatenate(centre)]
                    cos = unit(g["x"].tolist(), kind, dim) @ centre[0].T
                    best = cos.max(1)
                    to = pd.array(np.array(ids, dtype=np.int64)[cos.argmax(1)], dtype="Int64")
                    to[best < limit] = pd.NA
                    out.append(pd.DataFrame({"point": g["point"].array, "mult": g["mult"].array, "x": g["x"].array, "parent": node, "node": to, "d": distance(best)}))
            if out:
                yield pd.concat(out)

    return put(rows.mapInPandas(run, "point long, mult long, x binary, parent long, node long, d double"))


def _net(rest: DataFrame, sizes: DataFrame, turn: int, kind: str, radius: float, batch: int, put: Put) -> DataFrame:
    """(node, id, dim, x): new centres for each node among about batch bytes of its vectors that no centre covers yet."""
    share = F.pmod(F.xxhash64("point", F.lit(1000 + turn)), F.lit(1 << 30)) / float(1 << 30)
    most = F.greatest(F.lit(64.0), F.lit(float(batch)) / (F.col("dim") * 8))
    some = rest.join(sizes, "node").where(share < most / F.col("n")).select("node", "dim", "point", "x")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A node's candidates lie together, in order; the last node of a batch may go on in the next."""
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None and held is not None:
                b = pd.concat([held, b])
            ready, held = (held, None) if b is None else (b[b["node"] != b["node"].iloc[-1]], b[b["node"] == b["node"].iloc[-1]]) if len(b) else (None, held)
            if ready is not None and len(ready):
                nodes, dims = ready["node"].to_numpy(), ready["dim"].to_numpy()
                cuts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), nodes.size]
                x = ready["x"].tolist()
                kept = [s + k for s, e in zip(cuts[:-1], cuts[1:]) for k in net(unit(x[s:e], kind, int(dims[s])), radius)]
                yield ready.iloc[kept].rename(columns={"point": "id"})[["node", "id", "dim", "x"]]

    rows = some.repartition("node").sortWithinPartitions("node", "point")  # bounded by batch for each node
    return put(rows.mapInPandas(choose, "node long, id long, dim long, x binary"))


class Level:
    """A level of the tree. nodes: node, parent, dim, x, n, m, radius, first, leaf; members: point, mult, x, node, d."""

    def __init__(self, centres: DataFrame, members: DataFrame, last: float, put: Put):
        stats = members.groupBy("node").agg(F.count("*").alias("n"), F.sum("mult").alias("m"), F.max("d").alias("radius"), F.min("point").alias("first"))
        self.members, self.nodes = members, put(centres.join(stats, "node").withColumn("leaf", F.col("radius") <= last))


def grow(points: DataFrame, kind: str, reach: float, batch: int = NET, put: Put = materialize) -> list[Level]:
    """The levels from the root on. Nodes are named by the point that is their centre; leaves have no children."""
    last = max(reach / 2 - SLACK, FLOOR)
    roots = put(points.groupBy("dim").agg(F.min_by(F.struct("point", "x"), "point").alias("p"), F.count("*").alias("n")).select("dim", F.col("p.point").alias("node"), "p.x", "n"))
    members = points.join(roots.select("dim", "node"), "dim").select("point", "mult", "x", "node")
    members = _sent_down(members, roots.select("node", F.col("node").alias("id"), "dim", "x"), roots.select("node", "n"), kind, TOP + SLACK, put).drop("parent")
    levels = [Level(roots.select("node", F.lit(None).cast("long").alias("parent"), "dim", "x"), members, last, put)]
    while not (open_ := levels[-1].nodes.where("not leaf")).isEmpty():
        radius = TOP / 2 ** len(levels)
        below = levels[-1].members.join(open_.select("node"), "node", "left_semi")
        centres = open_.select("node", F.col("node").alias("parent"), "dim", "x")
        placed = below.where(F.col("d") <= radius)
        rest, turn = below.where(F.col("d") > radius).select("point", "mult", "x", "node"), 0
        while True:
            sizes = put(rest.groupBy("node").agg(F.count("*").alias("n")).join(open_.select("node", "dim"), "node"))
            if sizes.isEmpty():
                break
            new = _net(rest, sizes, turn, kind, radius, batch, put)
            sent = _sent_down(rest, new, sizes.select("node", "n"), kind, radius, put)
            centres = centres.unionByName(new.select(F.col("id").alias("node"), F.col("node").alias("parent"), "dim", "x"))
            placed = placed.unionByName(sent.where("node is not null").select("point", "mult", "x", "node", "d"))
            rest, turn = sent.where("node is null").select("point", "mult", "x", F.col("parent").alias("node")), turn + 1
        levels.append(Level(centres, put(placed), last, put))
    return levels


def _cells(rows: DataFrame, cell: int, put: Put) -> tuple[DataFrame, DataFrame]:
    """(rows with cell, (grp, cuts)) for rows (grp, id, dim, ..): a group's rows in cells of a bounded number of bytes."""
    cuts = put(rows.groupBy("grp").agg(F.ceil(F.count("*") * F.max("dim") * 8 / F.lit(cell)).alias("cuts")))
    return rows.join(cuts, "grp").withColumn("cell", F.pmod(F.xxhash64("id", F.lit(3)), F.col("cuts"))).drop("cuts"), cuts


FOUND = "what string, a long, b long, ca long, cb long, k long"


def _meet(pairs: DataFrame, rows: DataFrame, cuts: DataFrame, kind: str, job: Callable[[bool], object], put: Put) -> DataFrame:
    """FOUND by job(same) over all pairs of cells of pairs (l, h) of groups. rows: grp, cell, id, w, r, leaf, dim, x.
    One cell is held; the other is streamed past it."""
    spark = pairs.sparkSession
    many = lambda s: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{s}") - 1)).alias(f"c{s}")
    for s in "lh":
        pairs = pairs.join(cuts.select(F.col("grp").alias(s), F.col("cuts").alias(f"n{s}")), s)
    each = pairs.select("l", "h", "nh", many("l")).select("l", "h", "cl", many("h")).where("l <> h or cl <= ch")
    side = lambda s, k: each.join(rows.withColumnsRenamed({"grp": s, "cell": f"c{s}"}), [s, f"c{s}"]).select("l", "cl", "h", "ch", F.lit(k).alias("side"), "id", "w", "r", "leaf", "dim", "x")
    key = ["l", "cl", "h", "ch"]
    work = side("l", 0).unionByName(side("h", 1)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, task = None, None
        out = lambda t, k: pd.DataFrame(t.found(*k), columns=["what", "a", "b", "ca", "cb", "k"], dtype=object)
        for b in batches:
            done = []
            for (*at, s), g in b.groupby([*key, "side"], sort=False):
                if at != last:
                    if task:
                        done.append(out(task, last))
                    last, task = at, job(at[0] == at[2] and at[1] == at[3])
                x = unit(g["x"].tolist(), kind, int(g["dim"].iloc[0]))
                (task.stream if s else task.hold)(g["id"].to_numpy(), g["w"].to_numpy(), g["r"].to_numpy(), g["leaf"].to_numpy(), x)
            if done:
                yield pd.concat(done)
        if task:
            yield out(task, last)

    return put(work.mapInPandas(run, FOUND))


class _Cells:
    """Two cells that meet: the held one, and links seen so far as counts for each id and as edges."""

    def __init__(self, same: bool):
        self.same, self.parts, self.ids, self.k, self.edges = same, [], [], [], []

    def hold(self, *part) -> None:
        self.parts.append(part)

    def held(self):
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(c) for c in zip(*self.parts))]
        return self.parts[0]

    def link(self, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> None:
        """a and b link: each counts the other's weight, itself once; edges shrink to stars."""
        other = a != b
        ids, at = np.unique(np.concatenate([a, b[other]]), return_inverse=True)
        self.ids.append(ids)
        self.k.append(np.bincount(at, weights=np.concatenate([wb, wa[other]]), minlength=ids.size).astype(np.int64))
        if other.any():
            self.edges.append(stars(a[other], b[other]))

    def found(self, *key) -> list[tuple]:
        rows = []
        if self.ids:
            ids, at = np.unique(np.concatenate(self.ids), return_inverse=True)
            k = np.zeros(ids.size, np.int64)
            np.add.at(k, at, np.concatenate(self.k))
            rows += [("count", int(i), None, None, None, int(n)) for i, n in zip(ids, k)]
        if self.edges:
            a, b = stars(*(np.concatenate(c) for c in zip(*self.edges)))
            rows += [("star", int(i), int(j), None, None, None) for i, j in zip(a, b)]
        return rows


class Nodes(_Cells):
    """Children of two nodes: pairs to walk on with, pairs of leaves to compare, settled pairs as counts and stars, or both cells whole."""

    def __init__(self, same: bool, reach: float):
        super().__init__(same)
        self.reach, self.open, self.own, self.size, self.n_open = reach, [], [], 0, 0

    def stream(self, idh, wh, rh, leafh, xh) -> None:
        if not self.parts or self.n_open > OPEN:
            return
        idl, wl, rl, leafl, xl = self.held()
        self.size += idl.size * idh.size
        for s in range(0, idl.size, 1024):
            t = slice(s, s + 1024)
            cos = xl[t] @ xh.T
            far = float(rl[t].max() + rh.max()) + self.reach + SLACK
            i, j = np.nonzero(cos >= 1 - far * far / 2 - 1e-9)
            d, i = distance(cos[i, j]), i + s
            d[idl[i] == idh[j]] = 0.0
            r = rl[i] + rh[j]
            keep = d <= r + self.reach + SLACK
            if self.same:
                keep &= idl[i] <= idh[j]
            i, j, d, r = i[keep], j[keep], d[keep], r[keep]
            leaves = leafl[i] & leafh[j]
            inside = leaves & (d + r <= self.reach - SLACK)
            if inside.any():
                p, q = i[inside], j[inside]
                self.link(idl[p], wl[p], idh[q], wh[q])
                self.own += idl[p][idl[p] == idh[q]].tolist()
            p, q = i[~inside], j[~inside]
            self.n_open += p.size
            if self.n_open <= OPEN:
                self.open.append((idl[p], idh[q], leaves[~inside]))

    def found(self, l, cl, h, ch) -> list[tuple]:
        if self.n_open > min(OPEN, max(4096, DENSE * self.size)):
            return [("cell", l, h, cl, ch, None)]
        return super().found() + [("own", i, None, None, None, None) for i in self.own] + [("leaf" if f else "go", int(min(a, b)), int(max(a, b)), None, None, None) for x in self.open for a, b, f in zip(*x)]


class Vectors(_Cells):
    """Vectors of two cells: those that link, as counts and stars."""

    def __init__(self, same: bool, threshold: float):
        super().__init__(same)
        self.threshold = threshold

    def stream(self, idh, wh, rh, leafh, xh) -> None:
        if not self.parts:
            return
        idl, wl, _, _, xl = self.held()
        for i, j in compare(xl, xh, False, self.threshold):
            keep = idl[i] < idh[j] if self.same else slice(None)
            i, j = i[keep], j[keep]
            if i.size:
                self.link(idl[i], wl[i], idh[j], wh[j])


def dual(levels: list[Level], kind: str, reach: float, cell: int = CELL, put: Put = materialize) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what the pairs of nodes told: FOUND, units to compare: (l, h), their vectors: (grp, id, w, dim, x)). One round for each level."""
    named = lambda df, grp: df.select(grp.alias("grp"), F.col("node").alias("id"), F.col("m").alias("w"), F.col("radius").alias("r"), "leaf", "dim", "x")
    told, units, vectors, leaves, at = None, None, None, None, None
    more = lambda a, b: b if a is None else a.unionByName(b)
    pairs = levels[0].nodes.select(F.col("dim").alias("l"), F.col("dim").alias("h"))  # roots of each dim are a group of their own
    for i, level in enumerate(levels):
        # children of the pairs' nodes; a leaf of a level above stands for itself
        front = named(level.nodes, F.coalesce("parent", "dim"))
        front = front if leaves is None else front.unionByName(named(leaves, F.col("node")))
        rows, cuts = _cells(front, cell, put)
        seen = _meet(pairs, rows, cuts, kind, lambda same: Nodes(same, reach), put)
        held = level.nodes.where("leaf")
        leaves = held if leaves is None else leaves.unionByName(held)
        below = level.members.join(level.nodes.select("node", "dim", "leaf"), "node").select("node", "point", "mult", "dim", "x", "leaf")
        every = more(at, below)  # vectors of all nodes that this level's pairs can hold
        at = more(at, below.where("leaf"))
        name = lambda g, c: F.xxhash64(F.lit(i), g, c)  # noqa: B023, E731
        cells = seen.where("what = 'cell'").select(name(F.col("a"), F.col("ca")).alias("l"), name(F.col("b"), F.col("cb")).alias("h"))
        owners = rows.select(F.col("id").alias("node"), name(F.col("grp"), F.col("cell")).alias("grp"))
        need = cells.select(F.col("l").alias("grp")).union(cells.select("h")).distinct()
        told, units = more(told, seen), more(units, cells.select(F.least("l", "h").alias("l"), F.greatest("l", "h").alias("h")))
        vectors = more(vectors, every.join(owners.join(need, "grp"), "node").select("grp", F.col("point").alias("id"), F.col("mult").alias("w"), "dim", "x"))
        pairs = seen.where("what = 'go'").select(F.col("a").alias("l"), F.col("b").alias("h"))
    lone = told.where("what = 'leaf'").select(F.col("a").alias("l"), F.col("b").alias("h"))
    need = lone.select(F.col("l").alias("node")).union(lone.select("h")).distinct()
    vectors = vectors.unionByName(at.join(need, "node").select(F.col("node").alias("grp"), F.col("point").alias("id"), F.col("mult").alias("w"), "dim", "x"))
    return told, put(units.unionByName(lone)), put(vectors)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", batch: int = NET, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors. batch and cell bound tasks; they change no result."""
    made: list[DataFrame] = []

    def put(df: DataFrame) -> DataFrame:
        made.append(materialize(df))
        return made[-1]

    rows, points, kind = _points(vectors, id_col, vec_col)
    reach = float(np.sqrt(2 - 2 * threshold))
    levels = grow(points, kind, reach, batch, put)
    told, units, members = dual(levels, kind, reach, cell, put)
    tidy(vectors.sparkSession)
    cells, cuts = _cells(members.withColumns({"r": F.lit(0.0), "leaf": F.lit(True)}), cell, put)
    seen = _meet(units, cells, cuts, kind, lambda same: Vectors(same, threshold), put)
    leaves = None
    for level in levels:
        part = level.members.join(level.nodes.where("leaf").select("node", "first"), "node").select("node", "first", "point", "mult")
        leaves = part if leaves is None else leaves.unionByName(part)
    # settled pairs: a vector counts those of the other leaf, and those of its own leaf but for itself
    sums = told.where("what in ('count', 'own')").groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("k"), F.count_if(F.col("what") == "own").alias("own"))
    settled = put(leaves.join(sums, "node").withColumn("k", F.col("k") - F.col("own") * F.col("mult")))
    counts = settled.select("point", "k").unionByName(seen.where("what = 'count'").select(F.col("a").alias("point"), "k")).groupBy("point").agg(F.sum("k").alias("k"))
    first = settled.select("node", "first").distinct()
    ends = lambda s: first.select(F.col("node").alias(s), F.col("first").alias(f"p{s}"))
    edges = told.where("what = 'star'").join(ends("a"), "a").join(ends("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    edges = edges.unionByName(settled.select(F.col("point").alias("a"), F.col("first").alias("b"))).unionByName(seen.where("what = 'star'").select("a", "b"))
    comps = connected_components(edges)
    # ids of a component come from its points; those of rows without an id name none
    comps = materialize(comps.select(F.col("node").alias("point"), F.col("component").alias("c")))
    names = points.select("point", "rep").join(comps, "point").groupBy("c").agg(F.min("rep").alias("name"))
    each = points.select("point", "mult", "rep").join(counts, "point", "left").join(comps.join(names, "c"), "point", "left")
    each = materialize(each.select("point", (F.col("mult") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("name", "rep").alias("component_id")))
    release(*made)
    out = rows.where("point is not null").join(each, "point").select("vec_id", "n_links", "component_id")
    alone = rows.where("point is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
