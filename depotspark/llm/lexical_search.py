"""Ranked lexical search: postings in order of impact, score at a time, stopped by bounds, scores completed.

Terms are the maximal runs of letters, digits and what isn't ASCII, A-Z lower-cased, told by 64-bit hashes. A first pass over the
texts writes, for every document with terms, its length and the counts of the terms that some item has (a forward index); from
it come the numbers of documents, of terms and of documents for each term. Each task then takes the forward index in blocks of
bounded size and turns a block into postings grouped by exact impact w * s, each term's groups descending. For an item, whole
groups are added to the scores of the block's documents in descending order of impact. What remains is bounded: a document
can gain at most the sum of the terms' next impacts. The item stops when these bounds prove which documents are
its first k among those of the block and the task's earlier blocks, and the scores of the proven ones are completed from the
forward index; where ties or bounds don't allow that, it runs to the end. The first k of all tasks meet in two steps.

Defined cases: null texts have no terms; documents without terms count nowhere; items without terms, or whose terms are
nowhere, have no rows. Every row of documents is a document and every row of items an item of its own, also where ids repeat;
equal scores go by doc_id, null ids last. Extra columns are left out. Empty tables give no rows.
Items travel to the tasks, in blocks of BLOCK_BYTES of text; more items than that mean more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotspark.llm import tokens as W
from depotspark.llm.common import materialize, release, table

K = 50
#: Bytes of item texts that travel with one pass over the documents.
BLOCK_BYTES = 32 << 20
#: Postings that a task holds at once.
BLOCK_POSTINGS = 2_000_000
#: Scores are added in slabs of whole impact groups; each reaches down to this share of the last.
SLAB = 0.8

#: Bytes that part terms: ASCII but digits and letters.
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

SQL = r"""
with t as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
d as materialized (select r, doc_id, terms, len(terms) as n from t where len(terms) > 0),
a as (select count(*) as nn, sum(n)::bigint as ll from d),
tf as materialized (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) group by r, term),
df as (select term, count(*) as df from tf group by term),
w as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double)) as bigint) as w from df, a),
i as (select row_number() over () as i, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms from benchmark),
q as (select i, item_id, unnest(terms) as term from i),
s as (select q.i, q.item_id, d.r, d.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * d.n * nn) // ll)))) as score
  from q join w on q.term = w.term join tf on tf.term = q.term join d on d.r = tf.r, a group by q.i, q.item_id, d.r, d.doc_id),
o as (select item_id, row_number() over (partition by i order by score desc, doc_id) as rank, doc_id, cast(score as bigint) as score from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= 50
"""


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each row and the end)."""
    h, first, _ = W.words(texts, GAPS)
    return h, first


def forward_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs of every document with a term; terms are places in `vocabulary`, sorted hashes."""
    low = np.zeros(1 << 20, dtype=bool)
    low[vocabulary & np.uint64((1 << 20) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in W.slices(texts):
                h, first = term_hashes(texts[a:b])
                n = np.diff(first)
                there = np.flatnonzero(n)
                hit = np.flatnonzero(low[h & np.uint64((1 << 20) - 1)])
                if vocabulary.size:
                    at = np.minimum(np.searchsorted(vocabulary, h[hit]), vocabulary.size - 1)
                    same = vocabulary[at] == h[hit]
                    hit, at = hit[same], at[same]
                else:
                    hit = at = np.zeros(0, np.int64)
                row = np.searchsorted(first, hit, side="right") - 1
                code, tf = np.unique(row * max(1, vocabulary.size) + at, return_counts=True)
                row, term = np.divmod(code, max(1, vocabulary.size))
                ends = pa.array(np.r_[np.searchsorted(row, there), row.size].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].take(pa.array(there)), pa.array(n[there]), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, terms array<long>, tfs array<long>")


class Block:
    """Postings of some documents by term, in groups of exact impact, and the same by document."""

    def __init__(self, ids: list, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int):
        self.ids, self.first = ids, first
        big = 50 * docs * int(n.max(initial=0)) >= 1 << 63
        m = np.array([50 + 50 * int(x) * docs // length for x in n], dtype=np.int64) if big else 50 + 50 * n * docs // length
        doc = np.repeat(np.arange(n.size), np.diff(first))
        self.term, self.impact = term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((-self.impact, term))
        order = order[self.impact[order] > 0]
        self.by, self.doc, self.down = term[order], doc[order], -self.impact[order]

    def search(self, terms: np.ndarray, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the first k and those tied with the last. terms: the item's; wanted: for each term of the vocabulary, whether the item has it; floor: only scores from here on matter."""
        at, end = np.searchsorted(self.by, terms), np.searchsorted(self.by, terms, side="right")
        live = at < end
        at, end = at[live], end[live]
        score, left = np.zeros(len(self.ids), np.int64), 0
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not at.size:
            return nothing
        runs = [(self.doc[a:b], self.down[a:b]) for a, b in zip(at.tolist(), end.tolist())]
        pos, level = np.zeros(len(runs), np.int64), -min(int(d[0]) for _, d in runs)
        while level > 0:
            level = int(level * SLAB) if level > 16 else 0
            parts, left = [], 0
            for i, (doc, down) in enumerate(runs):  # whole groups: all postings of impact `level` or more
                stop = int(np.searchsorted(down, -level, side="right")) if level else down.size
                if stop > pos[i]:
                    parts.append((doc[pos[i] : stop], down[pos[i] : stop]))
                    pos[i] = stop
                left += -int(down[stop]) if stop < down.size else 0
            for doc, down in parts:
                score[doc] -= down  # a document has a term once
            if not left:
                break
            if self._proven(score, runs, pos, k, floor, left):
                break
        least = max(floor, 1, self._kth(score, k))
        found = np.flatnonzero(score + left >= least) if left else np.flatnonzero(score >= least)
        full = self.complete(found, wanted) if left else score[found]
        keep = full >= max(floor, 1)
        return found[keep], full[keep]

    @staticmethod
    def _kth(score: np.ndarray, k: int) -> int:
        return int(np.partition(score, score.size - k)[score.size - k]) if score.size >= k else 0

    def _proven(self, score: np.ndarray, runs: list, pos: np.ndarray, k: int, floor: int, left: int) -> bool:
        """Whether no document but k can reach the k-th score, by what remains for each."""
        least = max(floor, 1, self._kth(score, k))
        if left >= least:  # a document not met so far could still get in
            return False
        open_ = np.flatnonzero(score + left >= least)
        return open_.size <= k

    def complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores from the forward index."""
        return np.array([int(self.impact[a:b][wanted[self.term[a:b]]].sum()) for a, b in zip(self.first[docs], self.first[docs + 1])], dtype=np.int64)


def best(ids: list, scores: np.ndarray, k: int) -> list[int]:
    """Places of the k best: by score, then by id, null ids last."""
    return sorted(range(len(ids)), key=lambda i: (-int(scores[i]), ids[i] is None, ids[i] if ids[i] is not None else 0))[:k]


def _rank(index: DataFrame, items: list[np.ndarray], size: int, weight: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """i (place of the item), doc_id, score: the first k of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[tuple[list, np.ndarray]] = [([], np.zeros(0, np.int64)) for _ in items]
        wanted = np.zeros(size, dtype=bool)

        def block(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = (t.column(c).chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("terms", "tfs"))
            first = np.r_[0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs)]
            kind["doc_id"] = t.schema.field("doc_id").type
            b = Block(t.column("doc_id").to_pylist(), t.column("n").to_numpy(), first, *flat, weight, docs, length)
            for i, item in enumerate(items):
                ids, scores = tops[i]
                wanted[item] = True
                found, got = b.search(item, wanted, k, int(scores[-1]) if len(ids) >= k else 0)
                wanted[item] = False
                if found.size:
                    ids, scores = ids + [b.ids[j] for j in found], np.r_[scores, got]
                    order = best(ids, scores, k)
                    tops[i] = [ids[j] for j in order], scores[order]

        held, n, kind = [], 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += len(batch.column("terms").flatten())
            if n >= BLOCK_POSTINGS:
                block(held)
                held, n = [], 0
        if held:
            block(held)
        for i, (ids, scores) in enumerate(tops):
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array(ids, kind["doc_id"]), pa.array(scores, pa.int64())], names=["i", "doc_id", "score"])

    return index.where(F.size("terms") > 0).mapInArrow(run, f"i int, doc_id {dict(index.dtypes)['doc_id']}, score long")


def _first(rows: DataFrame, k: int) -> DataFrame:
    """rows (i, doc_id, score) with rank, the first k of each i; each of 32 hash groups gives its first k before they meet."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = Window.partitionBy("i", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
    near = rows.withColumn("r", F.row_number().over(group)).where(F.col("r") <= k).drop("r")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of each item's first k documents. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // BLOCK_BYTES + 1
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES of texts
        h, first = term_hashes(pa.array([r.text for r in rows], pa.string()))
        vocabulary = np.unique(h)
        terms = [np.unique(np.searchsorted(vocabulary, h[x:y])) for x, y in zip(first[:-1], first[1:])]
        index = materialize(forward_index(docs, vocabulary))
        n, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(vocabulary.size, np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row for each term of the items
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        found = materialize(_first(_rank(index, terms, vocabulary.size, weight, n, length, k), k))
        release(index)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"i int, item_id {dict(items.dtypes)['item_id']}")
        part = found.join(F.broadcast(names), "i").select("item_id", "rank", "doc_id", "score")  # the block's items
        out = part if out is None else out.unionByName(part)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
