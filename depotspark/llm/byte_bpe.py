"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Two forms share the ranks:

* `encode_words` follows the named method: Spark higher-order functions fold ranked merges over the byte pieces of
  distinct words, looking ranks up in a literal table (an array addressed by hash, since a literal map is searched
  entry by entry), and `decode_pieces` concatenates binary pieces.
* `encode` is the main path over documents: each task splits its texts, keeps the distinct chunks of a batch in a
  bounded memo and merges the byte pieces of those not seen yet. Carrying distinct words to a table of merged words
  and back needs a row for each word of each document twice, far beyond the disk limit (see README).

Only the ranks (their number is fixed by the file) are broadcast; each text is encoded whole in one row.

Defined cases: null text is the empty text with no tokens; special-token strings are ordinary text; very long runs of
one class are merged with a heap in n log n; repeated rows and other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm.common import table

MEMO = 250_000  # chunks that a worker remembers
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pairs:
    """The vocabulary as ranks of token pairs, for merging many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        found = [(ranks[t[:k]] << 20 | ranks[t[k:]]) << 20 | r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        packed = np.sort(np.array(found, dtype=np.int64))
        self.keys = np.append(packed >> 20, 1 << 62)
        self.rank = np.append(packed & ((1 << 20) - 1), NONE)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | np.maximum(right, 0)
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0), self.rank[at], NONE)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (none empty): in every round each word's pair of lowest rank, leftmost first, is merged."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 48)):
            every = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, every.size, 8192):
                rows = every[k : k + 8192]
                self._merge_rows(words, rows, sizes[rows], out)
        for i in np.flatnonzero(sizes > 48):
            w = words[i]
            out[i] = [self.ranks[w]] if w in self.ranks else _merge_long(w, self.ranks)
        return out

    def _merge_rows(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, out: list) -> None:
        width = int(sizes.max())
        ids = np.full((rows.size, width + 1), -1, dtype=np.int64)
        ids[np.arange(width + 1) < sizes[:, None]] = self.byte[np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8)]
        rank = self.of(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width + 1)
        while rows.size:
            at = rank.argmin(1)
            every = np.arange(rows.size)
            low = rank[every, at]
            done = low == NONE
            if done.any():
                for i, row, n in zip(rows[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(1).tolist()):
                    out[i] = row[:n]
                live = ~done
                rows, ids, rank, at, low = rows[live], ids[live], rank[live], at[live], low[live]
                every = np.arange(rows.size)
                if not rows.size:
                    break
            moved = cols[None, :] > at[:, None]
            ids = np.where(moved, np.concatenate([ids[:, 1:], np.full((rows.size, 1), -1)], 1), ids)
            rank = np.where(moved[:, :-1], np.concatenate([rank[:, 1:], np.full((rows.size, 1), NONE)], 1), rank)
            ids[every, at] = low
            rank[every, at] = self.of(low, ids[every, at + 1])
            left = at > 0
            e, c = every[left], at[left]
            rank[e, c - 1] = self.of(ids[e, c - 1], low[left])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here
    prev, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := prev[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts chunk by chunk. A chunk starts at a single space between other characters, where no pretoken crosses."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # \s of the vocabulary's pattern means Unicode white space
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.pairs = Pairs(ranks)
        self.pieces = {v: k for k, v in ranks.items()}
        self.digits = {v: str(v) for v in ranks.values()}
        self.memo: dict[str, tuple | None] = {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def _encode_new(self, strings: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """For each string: number of ids, their digits and the bytes decoded from them. Distinct pretokens are merged once."""
        split = [self.split.findall(x) for x in strings]
        words = list({w for ws in split for w in ws})
        pieces, digits = self.pieces, self.digits
        known = {}
        for w, ids in zip(words, self.pairs.merge_all([w.encode() for w in words])):
            known[w] = (len(ids), " ".join([digits[i] for i in ids]), b"".join([pieces[i] for i in ids]))
        out = {}
        for x, ws in zip(strings, split):
            if len(ws) == 1:
                out[x] = known[ws[0]]
            else:
                es = [known[w] for w in ws]
                out[x] = (sum([e[0] for e in es]), " ".join([e[1] for e in es]), b"".join([e[2] for e in es]))
        return out

    def texts(self, texts: list[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text the entries of its chunks."""
        memo = self.memo
        split = [t.split(" ") for t in texts]
        heads = [s[0] for s in split]
        new = set().union(*[s[1:] for s in split])
        if len(memo) + len(new) > MEMO:
            memo.clear()
        new.difference_update(memo)
        good = [c for c in new if c and not (c[0].isspace() or c[-1].isspace())]
        found = self._encode_new([" " + c for c in good])
        for c in new:
            memo[c] = found.get(" " + c)
        alone = [not h or h[-1].isspace() for h in heads]
        entries = [None if bad else list(map(memo.__getitem__, s[1:])) for s, bad in zip(split, alone)]
        odd = [e is None or None in e for e in entries]
        first = self._encode_new(list({t if o else h for t, h, o in zip(texts, heads, odd)}))
        for t, h, o, e in zip(texts, heads, odd, entries):
            yield ([first[t]] if t else []) if o else [first[h], *e]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for e in es for i in e[1].split(" ")] for es in self.texts(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        return [
            (sum([e[0] for e in es]), hashlib.sha256(" ".join([e[1] for e in es]).encode()).hexdigest(), hashlib.sha256(b"".join([e[2] for e in es])).hexdigest())
            for es in self.texts(texts)
        ]


def _slices(texts: list, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts (null: empty) in runs of about `most` characters."""
    run, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


_OWN: dict[tuple[str, str], Encoder] = {}


def _encoder(shared, path: str, pattern: str) -> Encoder:
    """One for each worker process, vocabulary file and pattern."""
    if (path, pattern) not in _OWN:
        _OWN.clear()
        _OWN[path, pattern] = Encoder(shared.value, pattern)
    return _OWN[path, pattern]


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _out(docs: DataFrame, fields: str) -> str:
    names = {x.split()[0] for x in fields.split(", ")}
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in names), fields])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids (array<int>); columns of these names are replaced."""
    path, pattern = _settings(path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    docs = docs.select(*[c for c in docs.columns if c not in ("n_tokens", "ids")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared, path, pattern)
        for b in batches:
            if b.empty:
                continue
            ids = [x for part in _slices(b[text_col]) for x in enc.encode(part)]
            yield b.assign(n_tokens=[len(x) for x in ids], ids=ids)

    return docs.mapInPandas(run, _out(docs, "n_tokens long, ids array<int>"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (ids array<int>) with decoded (binary)."""
    path, pattern = _settings(path, None)
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))
    encoded = encoded.select(*[c for c in encoded.columns if c != "decoded"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared, path, pattern)
        for b in batches:
            if b.empty:
                continue
            yield b.assign(decoded=[enc.decode(x) for x in b["ids"]])

    return encoded.mapInPandas(run, _out(encoded, "decoded binary"))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the bytes decoded from them, without sending the ids on."""
    path, pattern = _settings(path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared, path, pattern)
        for b in batches:
            if b.empty:
                continue
            rows = [x for part in _slices(b["text"]) for x in enc.digests(part)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def rank_slots(ranks: dict[bytes, int], spark: SparkSession) -> tuple[list[str], list[int], int]:
    """The ranks as a literal open-addressed table: piece in hex and rank by slot, and the most slots probed."""
    keys = spark.createDataFrame([(k.hex(), v) for k, v in ranks.items()], "k string, v int").select("k", "v", F.xxhash64("k").alias("h")).collect()
    size = 1 << (2 * len(keys)).bit_length()
    names, values, most = [""] * size, [-1] * size, 1
    for r in keys:
        at, probes = r.h % size, 1
        while names[at]:
            at, probes = (at + 1) % size, probes + 1
        names[at], values[at], most = r.k, r.v, max(most, probes)
    return names, values, most


def encode_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """words (word string, one row for each distinct pretoken) with ids, by higher-order functions alone."""
    spark = words.sparkSession
    names, values, most = rank_slots(load_ranks(_settings(path, None)[0]), spark)
    size = len(names)
    lit_names = F.split(F.lit(",".join(names)), ",")
    lit_values = F.transform(F.split(F.lit(",".join(map(str, values))), ","), lambda x: x.cast("int"))
    tables = F.broadcast(spark.range(1).select(lit_names.alias("_k"), lit_values.alias("_v")))
    none = F.lit(1 << 30)

    def rank(k: Column, v: Column, piece: Column) -> Column:
        at = F.pmod(F.xxhash64(piece), F.lit(size)).cast("int")
        out = none
        for i in range(most - 1, -1, -1):
            slot = F.pmod(at + i, F.lit(size))
            out = F.when(F.get(k, slot) == piece, F.get(v, slot)).otherwise(out)
        return out

    hexed = F.lower(F.hex(F.encode(F.col("word"), "UTF-8")))
    pieces = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1), lambda i: F.substr(hexed, (i * 2 + 1).cast("int"), F.lit(2)))

    def step(acc: Column) -> Column:
        n = F.size(acc)
        pairs = F.transform(F.slice(acc, 1, n - 1), lambda x, i: F.struct(rank(F.col("_k"), F.col("_v"), F.concat(x, F.get(acc, i + 1))).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        return F.element_at(
            F.transform(F.array(best), lambda b: F.when(b["r"] >= none, acc).otherwise(
                F.concat(F.slice(acc, 1, b["i"]), F.array(F.concat(F.get(acc, b["i"]), F.get(acc, b["i"] + 1))), F.slice(acc, b["i"] + 3, n))
            )), 1)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces) - 1)), pieces, lambda acc, _: F.when(F.size(acc) < 2, acc).otherwise(step(acc)))
    out = words.crossJoin(tables).withColumn("_p", folded)  # one row of tables
    return out.withColumn("ids", F.transform("_p", lambda p: rank(F.col("_k"), F.col("_v"), p))).withColumn("pieces", F.transform("_p", lambda p: F.unhex(p))).drop("_k", "_v", "_p")


def decode_pieces(pieces: Column) -> Column:
    """Bytes of an array of binary pieces."""
    return F.aggregate(pieces, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
