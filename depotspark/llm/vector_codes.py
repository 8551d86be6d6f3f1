"""Codes of vectors: eight codebooks of sixteen entries, trained and searched in integers by partial distances.

Method: a component x is floor(4096 * x). A vector is cut into 8 consecutive parts, each with a codebook that starts as that
part of the 16 vectors of smallest vec_id. Rounds assign every part to its nearest entry and replace each entry by the floor of
its parts' mean. The search goes through the dimensions of a part in descending variance over the codebook. It starts with the
complete distance of the entry that is nearest in the first dimension; masks over all pairs of a batch drop a pair as soon as
its accumulated distance strictly exceeds the best complete one, so ties stay and go to the lower index.

Tasks return sums for each entry and component, one row for each, whatever the number of vectors; codebooks (16 vectors for
each vector length) are all that the driver holds.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped. Integers saturate at 64 bits, as
Spark's cast does; sums and squares are exact beyond, and an error above 64 bits is the largest long. Vectors of different
lengths have codebooks of their own; a length that 8 doesn't divide is cut at floor(i * length / 8), so an empty vector has the
code of zeros and error 0. Rows of one vec_id are vectors of their own, ties of vec_id go by the vector, null ids come last. Fewer
than 16 vectors give as many entries. Null labels are one label. Extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotspark.llm.common import materialize, release, table

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Below this magnitude squares of differences add up in 64 bits for vectors of up to 65,536 components.
SMALL = 1 << 22
TOP = (1 << 63) - 1


def _sql() -> str:
    part = "list_transform(range(0, 8), lambda i: q[i * len(q) // 8 + 1 : (i + 1) * len(q) // 8])"
    ctes = [
        "k as materialized (select row_number() over (order by vec_id) - 1 as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as materialized (select r, unnest({part}) as v, unnest(range(0, 8)) as p from k)",
        "b0 as materialized (select p, cast(r as bigint) as e, v from p where r < 16)",
    ]
    near = "select r, p, v, e, d from (select p.r, p.p, p.v, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d, row_number() over (partition by p.r, p.p order by d, b.e) as o from p join {b} b on p.p = b.p) where o = 1"
    for i in range(ROUNDS):
        ctes.append(f"a{i} as materialized ({near.format(b=f'b{i}')})")
        ctes.append(f"s{i} as (select p, e, i, sum(x) as s, count(*) as c from (select p, e, unnest(v) as x, unnest(range(0, len(v))) as i from a{i}) group by p, e, i)")
        ctes.append(f"m{i} as (select p, e, list(cast((s - ((s % c) + c) % c) // c as bigint) order by i) as v from s{i} group by p, e)")
        ctes.append(f"b{i + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{i} b left join m{i} m on b.p = m.p and b.e = m.e)")
    ctes.append(f"f as materialized ({near.format(b=f'b{ROUNDS}')})")
    ctes.append("c as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from f group by r)")
    ctes.append(f"h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS})")
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join c on k.r = c.r, h"


SQL = _sql()


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, n (length) and q (integers) of the rows with a whole vector."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    q = F.transform(vector, lambda x: F.floor(F.lit(4096.0) * x.cast("double")))
    return rows.where(F.col(vector).isNotNull() & whole).select("vec_id", "label", F.size(vector).alias("n"), q.alias("q"))


def cuts(n: int) -> list[tuple[int, int]]:
    return [(i * n // PARTS, (i + 1) * n // PARTS) for i in range(PARTS)]


def exact(q: np.ndarray) -> np.ndarray:
    """q in 64 bits where all squares fit, else as Python's integers."""
    return q if not q.size or (-SMALL < q.min() and q.max() < SMALL and q.shape[1] <= 1 << 16) else q.astype(object)


def order_of(book: np.ndarray) -> np.ndarray:
    """Dimensions by descending variance over the codebook's entries, exact, ties by place."""
    big = book.astype(object)
    spread = len(big) * (big * big).sum(0) - big.sum(0) ** 2
    return np.array(sorted(range(book.shape[1]), key=lambda j: (-spread[j], j)), dtype=np.int64)


def nearest(q: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, by partial distances."""
    n = len(q)
    if not q.shape[1] or not n:
        return np.zeros(n, np.int64), np.zeros(n, q.dtype)
    first = (q[:, order[0], None] - book[None, :, order[0]]) ** 2
    start = book[first.argmin(1)]
    best = ((q - start) ** 2).sum(1)  # complete distances of one entry each
    row, entry = np.nonzero(first <= best[:, None])
    far = first[row, entry]
    for j in order[1:]:
        far = far + (q[row, j] - book[entry, j]) ** 2
        stay = (far <= best[row]).astype(bool)
        row, entry, far = row[stay], entry[stay], far[stay]
    # each row has the entry that it started with, or better ones; entries ascend inside a row
    least = np.minimum.reduceat(far, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
    hit = np.flatnonzero((far == least[row]).astype(bool))
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], least


def assign(q: np.ndarray, book: np.ndarray, orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, one column a part; squared distance over all parts)."""
    if q.dtype == object or book.dtype == object:
        q, book = q.astype(object), book.astype(object)
    found = [nearest(q[:, a:b], book[:, a:b], o) for (a, b), o in zip(cuts(q.shape[1]), orders)]
    return np.stack([e for e, _ in found], axis=1), sum(d for _, d in found)


Books = dict[int, tuple[np.ndarray, list[np.ndarray]]]


def _with_orders(books: dict[int, np.ndarray]) -> Books:
    return {n: (exact(b), [order_of(b[:, x:y]) for x, y in cuts(n)]) for n, b in books.items()}


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their integers)."""
    lengths, q = batch.column("n").to_numpy(zero_copy_only=False), batch.column("q")
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        flat = q.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(n), rows, exact(flat.reshape(len(rows), int(n)))


def train(kept: DataFrame) -> dict[int, np.ndarray]:
    """Codebooks of a table of integers (see integers) by vector length."""
    first = Window.partitionBy("n").orderBy(F.asc_nulls_last("vec_id"), "q")  # its row limit is met on the map side
    books: dict[int, np.ndarray] = {}
    for r in kept.select("n", "vec_id", "q").withColumn("e", F.row_number().over(first)).where(F.col("e") <= ENTRIES).orderBy("n", "e").select("n", "q").collect():
        books.setdefault(r.n, []).append(r.q)
    books = {n: np.array(b, dtype=np.int64).reshape(len(b), n) for n, b in books.items()}
    for _ in range(ROUNDS):
        ready = _with_orders(books)

        def sums(batches: Iterator[pa.RecordBatch], ready: Books = ready) -> Iterator[pa.RecordBatch]:
            total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for n, _, q in _groups(batch):
                    book, orders = ready[n]
                    entries, _ = assign(q, book, orders)
                    s, c = total.setdefault(n, (np.zeros((len(book), n), object), np.zeros((len(book), PARTS), np.int64)))
                    for p, (a, b) in enumerate(cuts(n)):
                        c[:, p] += np.bincount(entries[:, p], minlength=len(book))
                        order = np.argsort(entries[:, p], kind="stable")
                        there, at = np.unique(entries[order, p], return_index=True)
                        if b > a:
                            s[there, a:b] += np.add.reduceat(q[order, a:b], at, axis=0).astype(object)
            for n, (s, c) in total.items():
                e, j = np.nonzero(np.ones((len(s), n), bool))
                part = np.repeat(np.arange(PARTS), [b - a for a, b in cuts(n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(e.size, n), pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in s[e, j]], pa.decimal128(38, 0)), pa.array(c[e, part[j]], pa.int64())], names=["n", "e", "j", "s", "c"]
                )

        found = kept.select("n", "q").mapInArrow(sums, "n int, e int, j int, s decimal(38,0), c long").groupBy("n", "e", "j").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where("c > 0")
        books = {n: b.copy() for n, b in books.items()}
        for r in found.toLocalIterator():  # as many rows as the codebooks have numbers
            books[r.n][r.e, r.j] = int(r.s) // r.c
    return books


def digest(book: np.ndarray) -> str:
    """Of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for a, b in cuts(book.shape[1]) for e in book for x in e[a:b]).encode()).hexdigest()


def encode(kept: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, codebooks_sha256."""
    ready, names = _with_orders(books), {n: digest(b) for n, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows, q in _groups(batch):
                entries, error = assign(q, *ready[n])
                at = pa.array(rows)
                codes = [bytes(x).hex() for x in entries.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(codes, pa.string()), pa.array([min(int(x), TOP) for x in error], pa.int64()), pa.array([names[n]] * len(rows), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with the error summed over equal labels. A label's sum is combined on the map side; rows meet it in a join that splits hot labels."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(TOP))).cast("long")
    sums = codes.groupBy(F.col("label").alias("label_")).agg(total.alias("label_error"))
    return codes.join(sums, codes["label"].eqNullSafe(sums["label_"]), "left").drop("label_")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = materialize(integers(table(spark, sf_dir, "embeddings")))
    codes = materialize(encode(kept, train(kept)))
    release(kept)
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
