"""Line deduplication, vector codes and ranked search against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from depotspark.llm import lexical_search, line_dedup, vector_codes
from depotspark.llm.registry import ORACLE_SQL, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\f\r"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_vector_codes", "op13_lexical_search"])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert rows(df.select(*cols).collect()) == rows([[x[names.index(c)] for c in cols] for x in r.fetchall()])


# ---- lines


def kept_brute(docs, least_points=40, least_docs=5):
    """(doc_id, n_lines, n_dropped, text) for each (doc_id, text)."""
    key = lambda line: line.strip(SPACES).translate(LOW)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_points:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stays = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


LINE = "This passage stands in many documents, word for word"


def line_cases():
    r = random.Random(11)
    pool = [f"{LINE} and has number {k} {'ÄÖ' * (k % 3)}" for k in range(12)]
    docs = [(i, "\n".join(r.choice([*pool, "short", "", f"only here {r.random()} {'x' * 30}", "  " + pool[0].upper() + "\t\r"]) for _ in range(r.randint(0, 200)))) for i in range(40)]
    docs += [(None, pool[1]), (100, None), (101, ""), (102, "\n"), (103, "\n".join([pool[2]] * 3)), (103, "\n".join([pool[2]] * 3)), (103, pool[3])]
    docs += [(104 + i, LINE[:40] if i % 2 else LINE[:39]) for i in range(12)]
    docs += [(200, "\n".join([pool[4]] * 5000 + ["end"])), (7, pool[5] + "\n" + "Ünique " * 10)]
    return docs


def test_lines_against_brute_force(spark):
    docs = line_cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.apply_bitmaps(df, line_dedup.bitmaps(df)).select("row_.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, got)) == Counter(kept_brute(docs))


def test_hot_and_cold_keys_agree(spark):
    lines = line_dedup.line_keys(spark.createDataFrame(line_cases(), "doc_id long, text string"))
    none = spark.createDataFrame([], "k1 long")
    every = lines.select("k1").distinct()
    one, other = (Counter(map(tuple, line_dedup.dropped_lines(lines, hot).collect())) for hot in (none, every))
    assert one == other and sum(one.values()) > 2000


def test_sketch_finds_hot_keys(spark):
    rows_ = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k1"))
    assert [r.k1 for r in line_dedup.hot_keys(rows_).collect()] == [7]


def test_bitmaps_leave_out_full_words(spark):
    docs = [(i, "\n".join([f"line {i} {k}" for k in range(150)] + [LINE])) for i in range(6)]
    got = line_dedup.bitmaps(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4]
    assert all([(w.word, w.keep) for w in r.words] == [(2, ~(1 << 22))] for r in got)


def test_dedup_keeps_columns(spark):
    docs = [(i, LINE if i else None, f"a{i}", i, "k") for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row_ string, n_lines long, kept_text string")
    got = {tuple(r) for r in line_dedup.dedup(df).collect()}
    assert got == {(i, None if i == 0 else LINE if i == 6 else "", f"a{i}", i, "k") for i in range(7)}
    assert line_dedup.dedup(df.limit(0)).count() == 0


# ---- vector codes


def codes_brute(vectors):
    """vectors: (vec_id, label, list) of one length -> {vec_id: (code, error)}, digest."""
    n = len(vectors[0][2])
    q = {v: [math.floor(4096 * float(x)) for x in xs] for v, _, xs in vectors}
    parts = [(i * n // 8, (i + 1) * n // 8) for i in range(8)]
    books = [[q[v][a:b] for v in sorted(q)[:16]] for a, b in parts]

    def near(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p, (a, b) in enumerate(parts):
            mine = defaultdict(list)
            for v in q:
                mine[near(q[v][a:b], books[p])[1]].append(q[v][a:b])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else books[p][e] for e in range(len(books[p]))]
    out = {}
    for v in q:
        found = [near(q[v][a:b], books[p]) for p, (a, b) in enumerate(parts)]
        out[v] = "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), (1 << 63) - 1)
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<double>, label int"


def encoded(spark, data):
    kept = vector_codes.integers(spark.createDataFrame([(v, x, la) for v, la, x in data], SCHEMA))
    return kept, vector_codes.with_label_error(vector_codes.encode(kept, vector_codes.train(kept))).collect()


def test_codes_against_brute_force(spark):
    r = random.Random(12)
    data = [(i, r.choice([None, 1, 2]), [r.gauss(0, 1 / (1 + j % 5)) for j in range(20)]) for i in range(120)]
    data += [(200 + i, 3, data[5][2]) for i in range(30)]  # equal vectors
    want, digest = codes_brute(data)
    bad = [(-1, 1, None), (-2, 1, [None] * 20), (-3, 1, [float("nan")] * 20), (-4, 1, [float("inf")] + [0.0] * 19)]
    _, got = encoded(spark, data + bad)
    assert {x.vec_id: (x.code, x.error) for x in got} == want and {x.codebooks_sha256 for x in got} == {digest}
    sums = defaultdict(int)
    for v, la, _ in data:
        sums[la] += want[v][1]
    assert all(x.label_error == sums[x.label] for x in got)


def test_codes_of_odd_vectors(spark):
    r = random.Random(13)
    huge = [(i, 1, [r.choice([-1, 1]) * 10.0 ** r.randint(0, 12) for _ in range(9)]) for i in range(20)]
    short = [(100 + i, 2, [r.random(), r.random(), r.random()]) for i in range(4)]
    _, got = encoded(spark, huge + short + [(500, None, []), (501, None, [])])
    by = {x.vec_id: x for x in got}
    for part in (huge, short):
        want, digest = codes_brute(part)
        assert {v: (by[v].code, by[v].error) for v in want} == want and by[part[0][0]].codebooks_sha256 == digest
    assert by[500].code == "00" * 8 and by[500].error == 0
    assert encoded(spark, [])[1] == []


def test_partial_distances_keep_ties():
    r = np.random.default_rng(5)
    for _ in range(50):
        d, k = int(r.integers(1, 9)), int(r.integers(1, 17))
        q, book = r.integers(-3, 4, (200, d)), r.integers(-3, 4, (k, d))
        every = ((q[:, None] - book[None]) ** 2).sum(2)
        e, far = vector_codes.nearest(q, book, vector_codes.order_of(book))
        assert (e == every.argmin(1)).all() and (far == every.min(1)).all()


# ---- ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_brute(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        wanted = set(TERM.findall((text or "").translate(LOW)))
        scored = []
        for i, t in terms:
            tf, m = Counter(t), 50 + 50 * len(t) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in wanted if x in tf)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def search_cases():
    r = random.Random(14)
    word = lambda: "".join(r.choice("abXÄ9") for _ in range(r.choice([1, 2, 2, 3])))
    docs = [(i, r.choice([" ", ", ", "\n", "\x7f"]).join(word() for _ in range(int(r.paretovariate(0.7)) % 3000))) for i in range(300)]
    docs += [(None, "aa ab"), (None, "aa ab"), (400, None), (401, ""), (402, "-- !!"), (5, docs[5][1])] + [(500 + i, "aa bb ab 9") for i in range(80)]
    items = [(1, "aa ab, XX"), (2, None), (3, "nowhere-to-be-found"), (4, ""), (5, " ".join(word() for _ in range(40))), (5, "b"), (None, "9"), (6, "AA BB AB 9")]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_against_brute_force(spark, k, monkeypatch):
    docs, items = search_cases()
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 300)  # several blocks in a task
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score long")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = lexical_search.search(d, q, k)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == search_brute(docs, items, k)


def test_search_of_nothing_and_in_blocks(spark, monkeypatch):
    docs, items = search_cases()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 60)  # several passes
    assert Counter(map(tuple, lexical_search.search(d, q, 5).collect())) == search_brute(docs, items, 5)


def test_search_stops_early():
    """The bounds end a search before all postings are read, and the completed scores are exact."""
    r = np.random.default_rng(3)
    n, terms = 3000, 3
    first = np.arange(0, n * terms + 1, terms)
    term, tf = np.tile(np.arange(terms), n), r.integers(1, 4, n * terms)
    tf[: 3 * terms] = 400
    block = lexical_search.Block(list(range(n)), r.integers(400, 900, n), first, term, tf, np.array([900, 800, 700]), n, 600 * n)
    calls = []
    done = block.complete
    block.complete = lambda docs, wanted: calls.append(len(docs)) or done(docs, wanted)
    found, scores = block.search(np.arange(3), np.ones(3, bool), 3, 0)
    full = done(np.arange(n), np.ones(3, bool))
    assert calls == [3] and sorted(found) == [0, 1, 2] and (scores == full[found]).all() and (np.sort(scores) == np.sort(full)[-3:]).all()


def test_terms_are_the_pattern():
    texts = ["A-b_c9 Ünï\x7fx", None, "", "\x00a\x1fb", "日本 語!x", "a" * 100000]
    h, first = lexical_search.term_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [len(TERM.findall(t or "")) for t in texts]
