"""N-gram Jaccard join by count vectors in an R-tree; components of documents linked at 0.8 or more.

A document's set is its distinct 5-word shingles (64-bit hashes). Shingles fall into `GROUPS` hash groups, and the
group counts are the document's point. Two sets share at most the sum of the coordinate-wise minima of their
points, and a set shares at most that sum over a node's upper corner with any set below the node, so an R-tree over
the points finds every pair that can reach the threshold; surviving pairs are verified on the exact sets.

What makes this a distributed job:

* Equal sets are one node (a fingerprint of the set); copies are never paired.
* Points that must meet are dealt by signature groups. Under any fixed order of shingles, two sets at threshold t
  share one of their first a - ceil(t a) + 1 shingles. The order is: shingles that few sets have in front, by hash,
  then the frequent ones: those that many fronts hold by hash alone, and those that many of the fronts hold that come
  about when those are moved last. Each value is a block; equal blocks are one block. Whatever the order, the values
  are counted again in the fronts really used, and each that many sets hold is split by node hash into blocks of
  bounded size. Two sets with a value as their first common one share at most what each has from its place on; that gives
  each node the largest set that it can link with there, and nodes that fit no other one leave the block.
* In each block an R-tree of its points is searched. Two rounds ask only for each node's best partner in another
  component: the first in some blocks (near copies meet in very many), with each node of a split value compared with the
  value's hub, the node that can link with the most others, the second in every block that still holds several components;
  in a split value, nodes outside its commonest component are sent to all of its parts, in groups of bounded size. Their pairs are verified and joined to components. The
  last round takes the nodes that had any partner within the bound and the blocks that are open still, brings the exact
  sets together, and returns a forest of the links between different components. Every pair at the threshold is thus
  verified or lies inside one component already: no link is lost, and a group never makes all its pairs.

Defined cases: null, empty and blank texts have the empty set and link with nothing (component: their own id);
repeated rows are copies; rows with a null id link like others and are returned with a null component; ties need no order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm.common import connected_components, materialize, release, table, tidy
from depotspark.llm.tokens import mix, shingles, slices, words

GROUPS = 64  # coordinates of the R-tree
FINEST = 4096  # most groups that a point is kept with
LEAF = 16
HOT = 200  # a value that more sets have is frequent
PART = 256  # nodes in a part of a frequent value
CELL = 1_000  # rows in a cell
GUESTS = 1024  # nodes from elsewhere that are compared with a part at once
SOME = 16  # one block in so many is searched in the first round
MAX_HOT = 1_000_000  # most frequent values that are broadcast; beyond it HOT rises


def _per_doc(docs: DataFrame, schema: str, row) -> DataFrame:
    """Runs row(ids, sets) -> Arrow arrays over slices of each batch; docs: doc_id, text."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            for s, e in slices(text):
                part = text.slice(s, e - s)
                h, first, _ = words(part)
                out = row(b.column(0).slice(s, e - s), shingles(h, first))
                if out is not None and out[0] is not None:
                    yield pa.RecordBatch.from_arrays(out, names=[f[0] for f in fields])

    return docs.mapInArrow(run, schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(s: np.ndarray) -> int:
    """Of a set of hashes; also the node id. Independent of order."""
    with np.errstate(over="ignore"):
        return int(_signed(mix(np.array([np.add.reduce(mix(s + np.uint64(0x51ED270B))) + np.uint64(s.size)], dtype=np.uint64)))[0])


def point(s: np.ndarray) -> bytes:
    """Counts of a set in as many hash groups as keep a few shingles in each; folding halves gives the coarser points."""
    groups = GROUPS
    while groups < FINEST and groups * 8 < s.size:
        groups *= 2
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max(initial=0) > 65535:
        counts[:] = 65535  # bounds nothing, and so loses nothing
    return counts.astype(np.uint16).tobytes()


def _folded(vec: np.ndarray, groups: int) -> np.ndarray:
    """Counts in fewer groups: those that agree in the lower bits are added."""
    return vec if vec.size == groups else vec.reshape(-1, groups).sum(0, dtype=np.int64)


def _points(docs: DataFrame) -> DataFrame:
    def row(ids, sets):
        vec = [point(s) for s in sets]
        n = np.array([s.size for s in sets], dtype=np.int64)
        return [ids.cast(pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(n), pa.array(vec, pa.binary())]

    return _per_doc(docs, "doc_id long, node long, n long, vec binary", row)


def _signatures(docs: DataFrame, num: int, den: int, hot: np.ndarray | None, moved: bool = False) -> DataFrame:
    """(node, n, keys): the first shingles of each set in the order; hot: sorted frequent shingles that come last.

    moved: only of sets that hold one of hot in front by hash alone, and only what came in front instead.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot) if hot is not None and hot.size else None

    def row(ids, sets):
        last = shared.value if shared is not None else None
        nodes, sizes, keys = [], [], []
        for s in sets:
            n = s.size
            if not n:
                continue
            p = n - -(-num * n // den) + 1
            if last is not None:
                at = np.minimum(np.searchsorted(last, s), last.size - 1)
                often = last[at] == s
                rare = s[~often]
                if moved:
                    front = rare[p - int(np.count_nonzero(often[:p])) : p]
                    if not front.size:
                        continue
                else:
                    front = rare[:p] if rare.size >= p else np.concatenate([rare, s[often][: p - rare.size]])
            else:
                front = s[:p]
            nodes.append(fingerprint(s))
            sizes.append(n)
            keys.append(_signed(front))
        if not nodes:
            return None
        offsets = np.concatenate([[0], np.cumsum([k.size for k in keys])]).astype(np.int32)
        return [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))]

    return _per_doc(docs, "node long, n long, keys array<long>", row)


def _often(keys: DataFrame) -> DataFrame:
    """(key, c): values that more than HOT rows hold, HOT rising while there are more than MAX_HOT."""
    found, least = materialize(keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT)), HOT
    while found.count() > MAX_HOT:
        least *= 4
        last, found = found, materialize(found.where(F.col("c") > least))
        release(last)
    return found


def _sorted_keys(found: DataFrame) -> np.ndarray:
    return np.unique(found.select("key").toPandas()["key"].to_numpy(dtype=np.int64).view(np.uint64))  # bounded by MAX_HOT


def frequent(docs: DataFrame, num: int, den: int) -> np.ndarray:
    """Sorted shingles that come last. Moving some last brings others of the same sets in front, which are counted as well."""
    each = F.explode("keys").alias("key")
    first = _often(_signatures(docs, num, den, None).select(each))
    keys = _sorted_keys(first)
    release(first)
    if not keys.size:
        return keys
    second = _often(_signatures(docs, num, den, keys, True).select(each))
    keys = np.union1d(keys, _sorted_keys(second))
    release(second)
    return keys


class RTree:
    """Static R-tree over count vectors: leaves of LEAF points in order of size, nodes keep the upper corner and the size range."""

    def __init__(self, n: np.ndarray, vec: np.ndarray, num: int, den: int):
        self.n, self.vec, self.num, self.all = n, vec, num, num + den
        starts = np.arange(0, n.size, LEAF)
        hi, lo_n, hi_n = np.maximum.reduceat(vec, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        self.levels = [(hi, lo_n, hi_n)]
        while self.levels[-1][1].size > LEAF:
            hi, lo_n, hi_n = self.levels[-1]
            starts = np.arange(0, lo_n.size, LEAF)
            self.levels.append((np.maximum.reduceat(hi, starts), np.minimum.reduceat(lo_n, starts), np.maximum.reduceat(hi_n, starts)))

    def _fits(self, q: np.ndarray, a: int, hi: np.ndarray, lo_n: np.ndarray, hi_n: np.ndarray) -> np.ndarray:
        bound = np.minimum(np.minimum(q, hi).sum(1, dtype=np.int64), np.minimum(a, hi_n))
        return self.all * bound >= self.num * (a + lo_n)

    def search(self, q: np.ndarray, a: int) -> np.ndarray:
        """Points that can reach the threshold with (q, a)."""
        at = np.arange(self.levels[-1][1].size)
        for k in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[k]
            at = at[self._fits(q, a, hi[at], lo_n[at], hi_n[at])]
            size = self.levels[k - 1][1].size if k else self.n.size
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < size]
        bound = np.minimum(np.minimum(q, self.vec[at]).sum(1, dtype=np.int64), np.minimum(a, self.n[at]))
        return at[self.all * bound >= self.num * (a + self.n[at])]


def _search_block(node, n, most, fine: list[np.ndarray], comp, home, num, den) -> list[tuple[int, int]]:
    """Candidate pairs of one block between different components: each node's best.

    most: largest set that the node can link with here; home: the node belongs here (False: sent here to be compared with those that do).
    """
    if (comp == comp[0]).all():
        return []

    if node.size == 2:
        if n[0] > most[1] or n[1] > most[0]:
            return []
        g = min(fine[0].size, fine[1].size)
        bound = min(int(np.minimum(_folded(fine[0], g), _folded(fine[1], g)).sum()), int(n.min()))
        return [(int(node[0]), int(node[1]))] if home.any() and (num + den) * bound >= num * int(n.sum()) else []
    order = np.lexsort((node, n))
    node, n, most, comp, home = node[order], n[order], most[order], comp[order], home[order]
    fine = [fine[k] for k in order]
    sizes = np.array([v.size for v in fine])
    # for each number of groups, the points that are at least as fine, folded to it
    rows, at_rows = {}, {}
    for g in np.unique(sizes).tolist():
        members = np.flatnonzero(sizes >= g)
        rows[g] = np.stack([_folded(fine[k], g) for k in members])
        at_rows[g] = np.full(node.size, -1)
        at_rows[g][members] = np.arange(members.size)
    fine64 = np.stack([_folded(v, GROUPS) for v in fine]) if node.size > 2 * LEAF else None
    tree = RTree(n, fine64, num, den) if fine64 is not None else None
    out = []
    for i in range(node.size):
        at = tree.search(fine64[i], int(n[i])) if tree is not None else np.flatnonzero((num + den) * np.minimum(n[i], n) >= num * (n[i] + n))
        at = at[(comp[at] != comp[i]) & (home[at] | home[i]) & (n[at] <= most[i]) & (most[at] >= n[i])]
        if not at.size:
            continue
        bound = np.zeros(at.size, dtype=np.int64)
        common = np.minimum(sizes[at], sizes[i])
        for g in set(common.tolist()):
            k = np.flatnonzero(common == g)
            m = rows[g]
            bound[k] = np.minimum(m[at_rows[g][at[k]]], m[at_rows[g][i]]).sum(1, dtype=np.int64)
        ok = (num + den) * bound >= num * (n[i] + n[at])
        at, bound = at[ok], bound[ok]
        if at.size:
            x = at[np.argmax(bound / (n[at] + n[i]))]
            out.append((int(node[i]), int(node[x])))
    return out


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: cell, block, node, n, most, vec, comp, home -> distinct pairs (a, b), a < b: each node's best partner in each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, known = None, set()

        def search(b: pd.DataFrame) -> pd.DataFrame:
            ids = b["block"].to_numpy()
            node, n, most, comp, home = (b[c].to_numpy() for c in ("node", "n", "most", "comp", "home"))
            vec = [np.frombuffer(v, dtype=np.uint16) for v in b["vec"]]
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [ids.size]])
            found = set()
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s > 1:
                    found.update((min(p), max(p)) for p in _search_block(node[s:e], n[s:e], most[s:e], vec[s:e], comp[s:e], home[s:e], num, den))
            found -= known
            if len(known) > 500_000:
                known.clear()  # only spares repeats
            known.update(found)
            return pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if b.empty:
                continue
            last = b["block"].iloc[-1]
            if b["block"].iloc[0] != last:
                whole = (b["block"] != last).to_numpy()
                rest = b[~whole].reset_index(drop=True)
                yield search(b[whole].reset_index(drop=True))
            else:
                rest = b
        if rest is not None:
            yield search(rest)

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "block")
    return dealt.mapInPandas(run, "a long, b long").where("a != b").distinct()


def verify(docs: DataFrame, points: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose exact sets reach the threshold. Only one row of each node in a pair is read into words."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, points, ends)
    both = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("s", "sa"), "a").join(sets.withColumnRenamed("node", "b").withColumnRenamed("s", "sb"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    # repeated rows of one id give repeated pairs
    linked = materialize(both.where(den * inter >= num * (F.size("sa") + F.size("sb") - inter)).select("a", "b").distinct())
    release(sets)
    return linked


def _sets(docs: DataFrame, points: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, s): the exact sets of the nodes in ends, and perhaps of others: ids with several texts and null ids are read whole."""
    need = materialize(points.join(ends, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("need")).select("need").distinct())
    docs = docs.join(need, docs["doc_id"].eqNullSafe(need["need"]), "left_semi")
    seen: set[int] = set()  # of one task: repeated rows with a null id give one set

    def row(ids, sets):
        keep, nodes = [], []
        for i, s in enumerate(sets):
            if s.size and (node := fingerprint(s)) not in seen:
                seen.add(node)
                keep.append(i), nodes.append(node)
        return [pa.array(nodes, pa.int64()), pa.array([_signed(sets[i]) for i in keep], pa.list_(pa.int64()))]

    return materialize(_per_doc(docs, "node long, s array<long>", row))


def links(docs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all pairs at the threshold. docs: doc_id, text."""
    signed = _signatures(docs, num, den, frequent(docs, num, den))
    signed = materialize(signed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))  # copies have equal keys
    # with a value as the first common one, sets share at most what each has from there on: a limit of the other's size
    limit = F.floor((F.col("n") - F.col("pos")) * (num + den) / num).cast("long") - F.col("n")
    rows = signed.select("node", "n", F.posexplode("keys").alias("pos", "key")).select("key", "node", "n", limit.alias("most"))
    parts = materialize(_often(rows.select("key")).select("key", (F.floor(F.col("c") / PART) + 1).alias("parts")))
    rows = rows.join(F.broadcast(parts), "key", "left")  # at most MAX_HOT rows
    # a value is a block, a part of a frequent value is one
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(-1).cast("long")))
    hot = materialize(rows.where("part >= 0").select("key", "part", "node", "n", "most"))
    ends = hot.groupBy("key").agg(F.min("n").alias("low"), F.max("most").alias("high"))
    last, hot = hot, materialize(hot.join(F.broadcast(ends), "key").where("most >= low and n <= high").select(*hot.columns))  # at most MAX_HOT rows
    lists = rows.where("part < 0").select("key", "node", "n", "most").repartition("key").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "n", "most"))).alias("x")).where("size(x) > 1")
    # equal lists of nodes are one block; its limits are those of the first of its values, the largest of each node
    lists = lists.groupBy(F.col("x.node").alias("node"), F.col("x.n").alias("n")).agg(F.min("key").alias("key"), F.max("x.most").alias("most"))
    low, high = F.array_min("n"), F.array_max("most")
    fits = lists.withColumns({"low": low, "high": high}).select("key", F.filter(F.arrays_zip("node", "n", "most"), lambda x: (x["most"] >= F.col("low")) & (x["n"] <= F.col("high"))).alias("x"))
    lists = materialize(fits.where("size(x) > 1").select("key", F.transform("x", lambda x: F.struct(x["node"].alias("node"), x["most"].alias("most"))).alias("nodes")))
    release(signed, last)
    # also nodes alone in their part of a split value meet those of the other parts
    ends = lists.select(F.explode("nodes.node").alias("node")).unionByName(hot.select("node")).distinct()
    where = materialize(points.join(ends, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("vec").alias("vec")))
    # the node that can link with the most others of a split value is compared with all of them
    hubs = hot.groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b")), F.struct(F.col("most") / F.col("n"), "node")).alias("hub"))
    across = hot.join(F.broadcast(hubs.select("key", "hub.*")), "key").where("node != b and n <= most_b and n_b <= most")  # at most MAX_HOT rows
    across = across.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()

    every = lists.select("key", F.lit(-1).cast("long").alias("part"), F.explode("nodes").alias("x")).select("key", "part", "x.*").unionByName(hot.select("key", "part", "node", "most"))
    tried = found = comps = None
    for some in (every.where(F.pmod(F.xxhash64("key", "part"), F.lit(SOME)) == 0), every):
        pairs = _candidates(_dealt(_open_blocks(some, parts, comps)).join(where, "node"), num, den)
        if tried is None:
            pairs = pairs.unionByName(across).distinct()
        else:
            alive = materialize(pairs)
            pairs = alive.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        links_ = verify(docs, points, pairs, num, den)
        tried = pairs
        found = links_ if found is None else found.unionByName(links_)
        comps = materialize(connected_components(found)).withColumnRenamed("component", "comp")
        tidy(docs.sparkSession)
    # a node without any partner within the bound in the second round has none now
    nodes = materialize(alive.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    rows = _dealt(_open_blocks(every.join(nodes, "node", "left_semi"), parts, comps)).groupBy("cell", "node", "comp").agg(F.max("most").alias("most"))
    sets = _sets(docs, points, nodes)
    last = _remaining(rows, sets, num, den)
    release(sets, lists, hot, parts, where, nodes, alive)
    return found.unionByName(last)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (block, node, most, comp, home) of blocks that hold several components, with the cell that they are dealt to.

    Blocks with the same first node go to one cell, as near copies meet in many blocks; a cell of many rows is split by block.
    """
    blocks = rows.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("first"), F.count("*").alias("m")).where("lo != hi")
    split = blocks.groupBy("first").agg((F.floor(F.sum("m") / CELL) + 1).alias("cuts"))
    cells = blocks.join(split, "first").select("block", F.xxhash64("first", F.pmod(F.xxhash64("block"), F.col("cuts"))).alias("cell"))
    return rows.join(cells, "block")


def _remaining(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components among the nodes of a cell; rows: cell, node, comp, most; sets: node, s. Each cell returns a spanning forest."""

    def link(node: np.ndarray, comp: np.ndarray, most: np.ndarray, sets_: list[np.ndarray]) -> list[tuple[int, int]]:
        _, comp = np.unique(comp, return_inverse=True)  # renamed as components meet
        if comp.max() == 0:
            return []
        n = np.array([x.size for x in sets_])
        order = np.argsort(n, kind="stable")
        node, comp, most, n, sets_ = node[order].tolist(), comp[order], most[order], n[order], [sets_[k] for k in order]
        fine = [np.frombuffer(point(x), dtype=np.uint16) for x in sets_]
        fine64, out = np.stack([_folded(v, GROUPS) for v in fine]), []
        tree = RTree(n, fine64, num, den) if n.size > 2 * LEAF else None
        for i in range(len(node)):
            at = np.arange(i) if tree is None else tree.search(fine64[i], int(n[i]))
            at = at[at < i]
            at = at[(comp[at] != comp[i]) & (n[at] <= most[i]) & (most[at] >= n[i])]
            if tree is None and at.size:
                at = at[(num + den) * np.minimum(fine64[at], fine64[i]).sum(1, dtype=np.int64) >= num * (n[i] + n[at])]
            for x in at.tolist():
                if comp[x] == comp[i]:
                    continue
                g = min(fine[i].size, fine[x].size)
                if (num + den) * int(np.minimum(_folded(fine[i], g), _folded(fine[x], g)).sum(dtype=np.int64)) < num * int(n[i] + n[x]):
                    continue
                # sorted sets: the places of the smaller one's hashes in the other
                both = np.count_nonzero(sets_[i][np.minimum(np.searchsorted(sets_[i], sets_[x]), n[i] - 1)] == sets_[x])
                if (num + den) * both >= num * int(n[i] + n[x]):
                    comp[comp == comp[x]] = comp[i]
                    out.append((node[i], node[x]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> pa.RecordBatch:
            pairs = link(*(np.array([h[k] for h in held]) for k in range(3)), [h[3] for h in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            s = b.column(4)
            at, values = s.offsets.to_numpy(), s.values.to_numpy().view(np.uint64)
            for i, (cell, node, comp, most) in enumerate(zip(*[b.column(k).to_pylist() for k in range(4)])):
                if cell != last and held:
                    yield done()
                    held = []
                last = cell
                held.append((node, comp, most, values[at[i] : at[i + 1]].copy()))
        if held:
            yield done()

    dealt = rows.join(sets, "node").select("cell", "node", "comp", "most", "s").repartition("cell").sortWithinPartitions("cell")
    return materialize(dealt.mapInArrow(run, "a long, b long").distinct())


def _open_blocks(rows: DataFrame, parts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows (key, part, node, most; part -1: not split) -> blocks with more than one component: block, node, most, comp, home. In a
    split value, nodes outside its commonest component go to all parts."""
    block = F.xxhash64("key", "part")
    if comps is None:
        return rows.select(block.alias("block"), "node", "most", F.col("node").alias("comp"), F.lit(True).alias("home"))
    rows = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    plain, hot = rows.where("part < 0").withColumn("block", block), rows.where("part >= 0")
    several = plain.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("block")
    plain = plain.join(several, "block", "left_semi").select("block", "node", "most", "comp", F.lit(True).alias("home"))
    tops = hot.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.count("*").alias("k"), (F.sum("m") - F.max("m")).alias("others")).where("k > 1").join(parts, "key")
    tops = tops.select("key", "top", "parts", (F.floor(F.col("others") / GUESTS) + 1).alias("groups"))
    many = hot.join(tops, "key").withColumn("guest", F.col("comp") != F.col("top"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a part's own nodes meet each group of guests; a guest is in one group, in all parts
    many = many.withColumn("there", F.explode(F.when(F.col("guest"), numbers(F.col("parts"))).otherwise(F.array("part"))))
    own = F.col("part") == F.col("there")
    many = many.withColumn("group", F.explode(F.when(own, numbers(F.col("groups"))).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(3)), F.col("groups"))))))
    many = many.select(F.xxhash64("key", F.col("there").cast("long"), F.col("group").cast("long")).alias("block"), "node", "most", "comp", own.alias("home"))
    return plain.unionByName(materialize(many))  # it is read for the blocks and for the rows


def components(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); sets link when den * shared >= num * all."""
    docs = docs.select("doc_id", "text")
    points = materialize(_points(docs))
    edges = materialize(links(docs, points, num, den))
    tidy(docs.sparkSession)
    reps = points.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    ends = edges.join(reps.withColumnRenamed("node", "a").withColumnRenamed("rep", "ra"), "a").join(reps.withColumnRenamed("node", "b").withColumnRenamed("rep", "rb"), "b")
    ends = ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # texts that only rows with a null id have tie their neighbours together
    blank = points.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).where("rep is null").select("node")
    loose = materialize(edges.join(blank.withColumnRenamed("node", "a"), "a", "left_semi").unionByName(edges.join(blank.withColumnRenamed("node", "b"), "b", "left_semi")).distinct())
    if not loose.isEmpty():
        named = materialize(connected_components(loose).join(reps, "node").select("component", "rep"))
        ends = ends.unionByName(named.join(named.groupBy("component").agg(F.min("rep").alias("b")), "component").select(F.col("rep").alias("a"), "b"))
    # an id that occurs with several texts ties them together
    same_id = points.where("n > 0 and doc_id is not null").join(reps, "node").where("doc_id != rep").groupBy("node", "doc_id", "rep").agg(F.count("*").alias("c")).join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("rep", "doc_id")
    comps = connected_components(ends.unionByName(same_id.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    full = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
    out = points.select("doc_id", "node", F.col("n").alias("n_shingles")).join(full, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
