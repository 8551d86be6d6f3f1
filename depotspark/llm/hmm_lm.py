"""Hidden Markov language model: Baum-Welch over partitions, scaled forward recursion for exact likelihoods.

Tokens are lower-cased words and one end token. The model's alphabet is the `SYMBOLS` most frequent training tokens
and one symbol for each class of the other words (their length in bytes); a word of a class has the class's emission
times its add-one share within the class. So the likelihood of a text is a forward recursion over a bounded alphabet
times factors that need the word's training count, and those counts are joined, not broadcast: the `KNOWN` most
frequent tokens (a fixed bound) travel as a table, every other word of a text meets its count in a shuffle join.

Counting, training and scoring cover all rows. States start from texts far apart (a bounded sample of `ANCHORS` texts) and
mostly stay where they are. A Baum-Welch round maps over all training sequences, in pieces of `PIECE` tokens that see
`CONTEXT` more tokens on both sides, counts each token and move once, sums expected counts for each symbol across
partitions, and re-estimates on the driver over the bounded alphabet; rounds go on while the log likelihood of a
training token rises by `GAIN` or more (`ROUNDS` at most). Scoring does not cut: the forward recursion runs over each
whole text.

Words are identified by 64-bit hashes (see tokens). Defined cases: null and empty texts consist of the end token;
unseen words have count 0; a null id counts as the empty string for the fold; repeated rows are counted as often as
they occur; ties in frequency go by hash; with no training rows every count is 0 and scores use the uniform start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.llm.common import materialize, table
from depotspark.llm.tokens import slices, words

STATES = 8
SYMBOLS = 8192
KNOWN = 1 << 15
CLASSES = 24
ROUNDS = 6
GAIN = 0.002
ANCHORS = 256
PIECE, CONTEXT = 512, 64
END = 1  # stands for the end token among word hashes
FOLDS, HELD = 7, 2


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def _class(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, CLASSES) - 1


def token_counts(docs: DataFrame) -> DataFrame:
    """(w, cls, c) over all rows of docs (text): words and the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one count table for each Arrow batch keeps what is shuffled near the vocabulary
            hs, cs = [], []
            for s, e in slices(b.column(0), 1 << 22):
                h, _, size = words(b.column(0).slice(s, e - s))
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                hs.append((u, _class(size[at]), c))
            w = np.concatenate([x[0] for x in hs] + [np.array([END], np.uint64)])
            k = np.concatenate([x[1] for x in hs] + [np.array([-1])])
            c = np.concatenate([x[2] for x in hs] + [np.array([b.num_rows])])
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], names=["w", "cls", "c"])

    return docs.select("text").mapInArrow(run, "w long, cls int, c long").groupBy("w").agg(F.max("cls").alias("cls"), F.sum("c").alias("c"))


class Vocabulary:
    """The most frequent tokens, sorted by hash: their counts, and their symbols where they have one (else -1)."""

    def __init__(self, rows: list, symbols: int):
        words_ = np.array([r.w for r in rows], dtype=np.int64)
        counts = np.array([r.c for r in rows], dtype=np.int64)
        symbol = np.where(np.arange(len(rows)) < symbols, np.arange(len(rows)), -1)
        order = np.argsort(words_)
        self.words, self.counts, self.symbol = words_[order], counts[order], symbol[order].astype(np.int64)
        self.n = min(symbols, len(rows))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it isn't among them."""
        if not self.words.size:
            return np.full(h.size, -1)
        at = np.minimum(np.searchsorted(self.words, h), self.words.size - 1)
        return np.where(self.words[at] == h, at, -1)


def sequences(docs: DataFrame, vocabulary) -> DataFrame:
    """For each row: symbols (binary of uint16, end token included), sums over its frequent tokens, and its rarer words.

    vocabulary: a broadcast Vocabulary. log_c: sum of log10(c + 1) over tokens found; n_found: their number; rare_log:
    the part of log_c that belongs to words without a symbol of their own; rare: classes of such words (int8 binary);
    tail, tail_n, tail_cls: hashes of words outside the vocabulary and how often they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            for s, e in slices(b.column(2), 1 << 20):
                h, first, size = words(b.column(2).slice(s, e - s))
                h = h.view(np.int64)
                at, cls = v.find(h), _class(size)
                symbol = np.where(at >= 0, v.symbol[at] if v.symbol.size else -1, -1)
                own = symbol >= 0
                symbol = np.where(own, symbol, v.n + cls).astype(np.uint16)
                lg = np.where(at >= 0, np.log10(v.counts[at] + 1.0) if v.counts.size else 0.0, 0.0)
                end_at = int(v.find(np.array([END]))[0])
                end_symbol = np.array([v.symbol[end_at] if end_at >= 0 and v.symbol[end_at] >= 0 else v.n + CLASSES], np.uint16).tobytes()
                end_log = np.log10(v.counts[end_at] + 1.0) if end_at >= 0 else 0.0
                rows = []
                for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
                    miss = at[a:z] < 0
                    tail, where, times = np.unique(h[a:z][miss], return_index=True, return_counts=True)
                    rare = ~own[a:z]
                    rows.append((symbol[a:z].tobytes() + end_symbol, z - a + 1, float(lg[a:z].sum() + end_log), int(z - a - miss.sum() + (end_at >= 0)), float(lg[a:z][rare].sum()), np.bincount(cls[a:z][rare], minlength=CLASSES).tolist() if rare.any() else [], tail.tolist(), times.tolist()))
                cols = list(zip(*rows))
                types = [pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "held_out", "symbols", "n_tokens", "log_c", "n_found", "rare_log", "rare", "tail", "tail_n"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, symbols binary, n_tokens long, log_c double, n_found long, rare_log double, rare array<long>, tail array<long>, tail_n array<long>")


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbols x states, columns sum to 1

    @classmethod
    def first(cls, counts: np.ndarray, states: int, texts: list[np.ndarray] | None = None, stay: float = 0.9) -> Model:
        """Unigram shares, mixed with those of texts that are far apart: the next text is the one farthest from all before."""
        unigram = (counts + 0.5) / (counts + 0.5).sum()
        texts = [x for x in texts or [] if x.size]
        if not texts:
            texts = [np.arange(k, counts.size, states) for k in range(states)]
        seen = np.array([np.bincount(x, minlength=counts.size) / x.size for x in texts])
        root = np.sqrt(seen)
        near = root @ np.sqrt(unigram)
        chosen = [int(near.argmax())]
        near = root @ root[chosen[0]]
        while len(chosen) < states:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, root @ root[chosen[-1]])
        emit = 0.5 * unigram[:, None] + 0.5 * seen[chosen].T
        # states that start from the same text are told apart
        emit *= np.random.default_rng(11).uniform(0.9, 1.1, emit.shape)
        move = np.full((states, states), (1 - stay) / states) + stay * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))


def pieces_of(s: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """(tokens, first and end of those that count): pieces with context on both sides."""
    return [(s[max(0, k - CONTEXT) : k + PIECE + CONTEXT], min(k, CONTEXT), min(k, CONTEXT) + min(PIECE, s.size - k)) for k in range(0, s.size, PIECE)]


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(longest x sequences, lengths), longest first."""
    sizes = np.array([s.size for s in seqs])
    out = np.zeros((int(sizes.max()), sizes.size), dtype=np.int64)
    for k, s in enumerate(seqs):
        out[: s.size, k] = s
    return out, sizes


def log_likelihoods(model: Model, seqs: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """log10 probability of each whole sequence: forward recursion, scaled at each step, over many sequences at once."""
    out = np.zeros(len(seqs))
    order = sorted((i for i in range(len(seqs)) if seqs[i].size), key=lambda i: -seqs[i].size)
    # sequences side by side are near in length, and a group holds a bounded number of cells
    k = 0
    while k < len(order):
        m = max(1, min(width, (1 << 22) // seqs[order[k]].size))
        group = order[k : k + m]
        k += m
        sym, sizes = _padded([seqs[i] for i in group])
        alpha = model.start * model.emit[sym[0]]
        total = np.zeros(sizes.size)
        for t in range(sym.shape[0]):
            if t:
                live = int(np.searchsorted(-sizes, -t, side="left"))
                alpha = (alpha[:live] @ model.move) * model.emit[sym[t, :live]]
            c = alpha.sum(1)
            alpha = alpha / c[:, None]
            total[: c.size] += np.log10(c)
        out[group] = total
    return out


def expected_counts(model: Model, pieces: list[tuple[np.ndarray, int, int]], width: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (symbols x states) of the tokens that count, by the forward-backward recursion, and their log10 likelihood."""
    states = model.start.size
    starts, moves, log = np.zeros(states), np.zeros((states, states)), 0.0
    emits = np.zeros((model.emit.shape[0], states))
    pieces = sorted((p for p in pieces if p[0].size), key=lambda p: -p[0].size)
    for k in range(0, len(pieces), width):
        group = pieces[k : k + width]
        sym, sizes = _padded([p[0] for p in group])
        lo, hi = np.array([p[1] for p in group]), np.array([p[2] for p in group])
        steps = sym.shape[0]
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]
        counted = [((lo[:n] <= t) & (t < hi[:n]))[:, None] for t, n in enumerate(live)]
        alphas, scales = [], []
        for t in range(steps):
            e = model.emit[sym[t, : live[t]]]
            a = model.start * e if t == 0 else (alphas[-1][: live[t]] @ model.move) * e
            c = a.sum(1, keepdims=True)
            alphas.append(a / c)
            scales.append(c)
            log += float(np.log10(c[counted[t]]).sum())
        beta = np.ones((live[-1], states))
        for t in range(steps - 1, -1, -1):
            gamma = alphas[t] * beta
            gamma *= counted[t] / gamma.sum(1, keepdims=True)
            if t:
                right = model.emit[sym[t, : live[t]]] * beta / scales[t]
                moves += model.move * (alphas[t - 1][: live[t]].T @ (right * counted[t]))
                full = np.ones((live[t - 1], states))
                full[: live[t]] = right @ model.move.T
                beta = full
            else:
                starts += gamma.sum(0)
            alphas[t] = gamma
        where, g = np.concatenate([sym[t, : live[t]] for t in range(steps)]), np.concatenate(alphas)
        for z in range(states):
            emits[:, z] += np.bincount(where, weights=g[:, z], minlength=emits.shape[0])
    return starts, moves, emits, log


def baum_welch(seqs: DataFrame, model: Model, rounds: int, tokens: int, gain: float = GAIN) -> Model:
    """seqs: symbols of training rows (tokens in all). Each round sums expected counts over all partitions, keyed by symbol."""
    spark = seqs.sparkSession
    states, size = model.start.size, model.emit.shape[0]
    last = -np.inf
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            sums, held, n = None, [], 0

            def add() -> None:
                nonlocal sums, held, n
                got = expected_counts(m, held)
                sums, held, n = got if sums is None else tuple(x + y for x, y in zip(sums, got)), [], 0

            for b in batches:
                for x in b.column(0):
                    s = np.frombuffer(x.as_py(), dtype=np.uint16).astype(np.int64)
                    held += pieces_of(s)
                    n += s.size
                    if n > 1 << 19:  # bounds what is held, and keeps many pieces side by side
                        add()
            if held:
                add()
            if sums is not None:
                starts, moves, emits, log = sums
                keys = np.concatenate([[-1], -2 - np.arange(states), [-2 - states], np.flatnonzero(emits.any(1))])
                values = np.concatenate([starts[None], moves, np.full((1, states), log), emits[keys[2 + states :]]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *[pa.array(values[:, z]) for z in range(states)]], names=["key", *[f"s{z}" for z in range(states)]])

        cols = [f"s{z}" for z in range(states)]
        found = seqs.select("symbols").mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in cols)).groupBy("key").agg(*[F.round(F.sum(c), 6).alias(c) for c in cols]).toPandas()  # at most the alphabet and the states
        shared.destroy()
        starts, moves, emits, log = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
        for r in found.itertuples(index=False):
            v = np.array(r[1:])
            if r.key == -1:
                starts = v
            elif r.key == -2 - states:
                log = v[0] / max(1, tokens)
            elif r.key < -1:
                moves[-2 - r.key] = v
            else:
                emits[r.key] = v
        start, move, emit = starts + 0.1, moves + 0.1, emits + 0.1 * model.emit + 1e-6
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        if log - last < gain:
            break
        last = log
    return model


def score(docs: DataFrame, states: int = STATES, symbols: int = SYMBOLS, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    if symbols + CLASSES + 1 > 1 << 16:
        raise ValueError("symbols are kept in 16 bits")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out())
    counts = materialize(token_counts(docs.where(~F.col("held_out"))))
    by_class = {r.cls: (r.n, r.v) for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = sum(x[0] for x in by_class.values()), sum(x[1] for x in by_class.values())
    top = list(counts.orderBy(F.desc("c"), "w").limit(known).toPandas().itertuples(index=False))  # a fixed number of tokens
    vocabulary = Vocabulary(top, symbols)
    shared = spark.sparkContext.broadcast(vocabulary)
    seqs = materialize(sequences(docs, shared).withColumn("row", F.monotonically_increasing_id()))

    # training counts of the words without a symbol of their own, by class
    own_n, own_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in top[: vocabulary.n]:
        if r.cls >= 0:
            own_n[r.cls] += r.c
            own_v[r.cls] += 1
    rest_n = np.array([by_class.get(k, (0, 0))[0] for k in range(CLASSES)]) - own_n
    rest_v = np.array([by_class.get(k, (0, 0))[1] for k in range(CLASSES)]) - own_v
    first = np.zeros(vocabulary.n + CLASSES + 1)
    first[: vocabulary.n] = [r.c for r in top[: vocabulary.n]]
    first[vocabulary.n : -1] = rest_n
    train = seqs.where(~F.col("held_out"))
    some = train.where(F.col("n_tokens") > 20).orderBy(F.xxhash64("symbols")).limit(ANCHORS).select(F.substring("symbols", 1, 4096).alias("s")).collect()
    model = baum_welch(train, Model.first(first, states, [np.frombuffer(r.s, dtype=np.uint16).astype(np.int64) for r in some]), rounds, n)
    sent = spark.sparkContext.broadcast((model, np.log10(rest_n + rest_v + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, norm = sent.value
        for b in batches:
            if b.empty:
                continue
            lik = log_likelihoods(m, [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in b["symbols"]])
            rare = [float(np.dot(x, norm)) if len(x) else 0.0 for x in b["rare"]]
            yield b.drop(columns=["symbols", "rare"]).assign(lik=lik - rare)

    # words outside the frequent ones meet their counts in a shuffle; then they are summed for each text
    words_ = seqs.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("row", F.col("x.tail").alias("w"), F.col("x.tail_n").alias("k"))
    met = words_.join(counts.select("w", "c"), "w")
    sums = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("t_log"), F.sum("k").alias("t_n"))
    main = seqs.select("row", "doc_id", "held_out", "symbols", "n_tokens", "log_c", "n_found", "rare_log", "rare")
    scored = main.mapInPandas(run, "row long, doc_id long, held_out boolean, n_tokens long, log_c double, n_found long, rare_log double, lik double")
    out = scored.join(sums, "row", "left")
    t_log, t_n = F.coalesce("t_log", F.lit(0.0)), F.coalesce("t_n", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_found") + t_n).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + t_log - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("lik") + F.col("rare_log") + t_log).alias("score"),
    )


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
