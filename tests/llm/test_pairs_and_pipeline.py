"""Pair operators and the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from depotspark.llm import common, cover_tree, mixing, ngram_join

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(texts, num=80, den=100):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], groups(len(sets), links)


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string")
    got = ngram_join.components(docs).orderBy("doc_id").collect()
    n, comp = brute(texts)
    assert [r.n_shingles for r in got] == n
    assert [r.component_id for r in got] == comp


def test_join_query(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = ngram_join.op2_ngram_jaccard(spark, SF).orderBy("doc_id").collect()
    n, comp = brute(list(d.text))
    ids = list(d.doc_id)
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(i, a, ids[c]) for i, a, c in zip(ids, n, comp)]


def test_join_near_copies_of_every_kind(spark):
    """Chains at the threshold, a large group of near copies, copies, short texts, a line that all share."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [None, "", "  \n", "one", "One", "a b c d", "a b c d e", "A b c d e"]
    base = [word() for _ in range(120)]
    for _ in range(260):
        t = list(base)
        for k in r.sample(range(120), r.choice([0, 1, 1, 2, 3, 4])):
            t[k] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(60)]
    for _ in range(30):
        texts.append(" ".join(chain))
        chain = chain[2:] + [word() for _ in range(2)]
    shared = " ".join(word() for _ in range(9))
    texts += [shared + " " + " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(120)]
    texts += [texts[20]] * 40
    texts.append(" ".join(word() for _ in range(30000)))
    check(spark, texts)


def test_join_with_few_frequent_values(spark, monkeypatch):
    """Splitting frequent values into parts loses nothing."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "PART", 4)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(50)] for _ in range(3)]
    texts = []
    for _ in range(90):
        t = list(r.choice(bases))
        for k in r.sample(range(50), r.choice([0, 1, 2])):
            t[k] = word()
        texts.append(" ".join(t))
    check(spark, texts)


def test_join_splits_every_frequent_value(spark, monkeypatch):
    """Near copies of one text and texts that are mostly one passage: no block holds the whole group, and no link is lost."""
    monkeypatch.setattr(ngram_join, "HOT", 40)
    monkeypatch.setattr(ngram_join, "PART", 16)
    sizes, opened = [], ngram_join._open_blocks

    def watched(lists, parts, comps):
        out = opened(lists, parts, comps)
        sizes.append(out.where("home").groupBy("block").count().agg({"count": "max"}).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_join, "_open_blocks", watched)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(80)]
    texts = []
    for _ in range(300):
        t = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3])):
            t[k] = word()
        texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(r.randint(8, 40))]) for _ in range(200)]
    check(spark, texts)
    assert max(sizes) <= 64


def test_join_sends_few_nodes_to_all_parts(spark, monkeypatch):
    """Near copies of one text of which many are too far from all others: they are not compared with every part of the group."""
    monkeypatch.setattr(ngram_join, "HOT", 40)
    monkeypatch.setattr(ngram_join, "PART", 16)
    sent, opened = [], ngram_join._open_blocks

    def watched(rows, parts, comps):
        out = opened(rows, parts, comps)
        sent.append(out.where("not home").count())
        return out

    monkeypatch.setattr(ngram_join, "_open_blocks", watched)
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for k in [1, 2, 3] * 40 + [5] * 180:
        t = list(base)
        for at in r.sample(range(0, 150, 8), k):
            t[at] = word()
        texts.append(" ".join(t))
    check(spark, texts)
    assert max(sent) <= 30_000  # 21,763; without limits of size 62,624


def test_join_of_nodes_alone_in_their_parts(spark, monkeypatch):
    """A common line links to each text that adds one word to it, but these do not link with each other."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "PART", 1)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(8):
        line = " ".join(word() for _ in range(9))
        texts += [line, *(line + " " + word() for _ in range(12))]
    check(spark, texts)


def test_join_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (5, None)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (5, 0, 5)]
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_near_copies_with_null_ids(spark):
    """A null id on a near copy stops nothing, and the row still links its neighbours."""
    w = [f"w{i}" for i in range(60)]
    shifted = [" ".join(w[k : k + 40]) for k in (0, 3, 6)]
    rows = [(1, shifted[0]), (None, shifted[1]), (None, shifted[1]), (3, shifted[2]), (4, " ".join(w[30:]))]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 36, 0), (0, 36, 0), (1, 36, 1), (3, 36, 1), (4, 26, 4)]


def test_bound_is_an_upper_bound():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 4000, r.integers(1, 1500)).astype(np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.point(s), np.uint16) for s in (a, b))
        g = min(x.size, y.size)
        fine = np.minimum(ngram_join._folded(x, g), ngram_join._folded(y, g)).sum(dtype=np.int64)
        coarse = np.minimum(ngram_join._folded(x, 64), ngram_join._folded(y, 64)).sum(dtype=np.int64)
        assert np.intersect1d(a, b).size <= fine <= coarse


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    comp = groups(300, edges)
    got = {x.node: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == comp[n] for e in edges for n in e if e[0] != e[1])
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_brute(rows, t=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(rows[i][1], dtype=float) / np.abs(rows[i][1]).max() for i in ok}
    x = {i: v / np.sqrt((v * v).sum()) for i, v in x.items()}
    near = [(i, j) for i in ok for j in ok if j < i and x[i].size == x[j].size and float((x[i] * x[j]).sum()) >= t]
    n = collections.Counter(k for e in near for k in e)
    ids = [r[0] for r in rows]
    comp = groups(len(rows), near)
    low = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            low[c] = min(low.get(c, ids[i]), ids[i])
    return [(ids[i], n[i], low.get(c)) for i, c in enumerate(comp)]


def by_id(rows):
    return sorted(((a, n, c) for a, n, c in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0))


@pytest.mark.parametrize("batch,cell", [(32 * 64, 32 * 50), (32 * 100, 32 * 7), (cover_tree.NET, cover_tree.CELL)])
def test_cover_tree(spark, batch, cell):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=4).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, (np.array(rows[i % 9][1]) + r.normal(size=4) * 0.05).tolist()) for i in range(200)] + [(2000 + i, rows[3][1]) for i in range(30)]
    rows += [(2100 + i, (np.array(rows[5][1]) + r.normal(size=4) * 0.001).tolist()) for i in range(60)]  # all within half of the reach
    rows += [(3000, None), (3001, [0.0] * 4), (3002, [1.0, None, 0.0, 0.0]), (3003, [float("nan")] * 4), (3004, [float("inf"), 0.0, 0.0, 0.0]), (3005, [1.0]), (3006, [])]
    rows += [(4000 + i, (r.normal(size=2) * 10.0 ** r.integers(-200, 200)).tolist()) for i in range(40)] + [(4100, [1e200, 1e200, 0.0]), (4101, [1e-200, 1e-200, 0.0]), (4102, [1e-308, 1e-308, -0.0])]
    rows += [(None, rows[0][1]), (None, (np.array(rows[1][1]) * 2).tolist())]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, n_links int")
    got = by_id((x.vec_id, x.n_links, x.component_id) for x in cover_tree.near_duplicates(df, batch=batch, cell=cell).collect())
    assert got == by_id(vectors_brute(rows))


def test_cover_tree_empty(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert cover_tree.near_duplicates(spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<double>")).count() == 2


def test_cover_tree_chain_through_rows_without_id(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(7, turn(0.0)), (None, turn(0.3)), (9, turn(0.6))]
    got = {(x.vec_id, x.n_links, x.component_id) for x in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(7, 1, 7), (None, 2, 7), (9, 1, 7)}


def test_cover_tree_query(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = cover_tree.op9_cover_tree(spark, SF).toPandas().set_index("vec_id")
    want = {a: (n, c) for a, n, c in vectors_brute([(int(a), np.asarray(v, dtype=float).tolist()) for a, v in zip(e.vec_id, e.embedding)])}
    assert {a: (r.n_links, r.component_id) for a, r in got.iterrows()} == want and (got.kept == (got.index == got.component_id)).all()


def test_levels_nest_cover_and_separate(spark):
    """Each level: own centres go on, every vector within the level's radius of its centre, children of a node farther apart than that."""
    r = np.random.default_rng(6)
    x = np.concatenate([np.repeat(np.eye(8), 40, 0) + r.normal(size=(320, 8)) * 0.05, r.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, points, kind = cover_tree._points(df, "vec_id", "embedding")
    levels = cover_tree.grow(points, kind, 0.316, 64 * 64)
    at = {p.point: cover_tree.unit([p.x], kind, 8)[0] for p in points.collect()}
    gone, last = set(), None
    assert len(levels) == 5
    for i, level in enumerate(levels):
        nodes = {n.node: n for n in level.nodes.collect()}
        members = {m.point: m.node for m in level.members.collect()}
        assert set(members) | gone == set(at) and not set(members) & gone
        assert all(np.linalg.norm(at[p] - at[n]) <= min(2 / 2**i, nodes[n].radius) + 1e-6 for p, n in members.items())
        assert all(members[n] == n for n in nodes)
        if last is not None:
            assert {n for n, v in last.items() if not v.leaf} <= set(nodes) and {v.parent for v in nodes.values()} == {n for n, v in last.items() if not v.leaf}
            kids = collections.defaultdict(list)
            for n, v in nodes.items():
                kids[v.parent].append(at[n])
            for k in kids.values():
                d = np.linalg.norm(np.array(k)[:, None] - np.array(k)[None], axis=2) + 9 * np.eye(len(k))
                assert d.min() > 2 / 2**i - 1e-6
        last, gone = nodes, gone | {p for p, n in members.items() if nodes[n].leaf}
    assert gone == set(at)


def test_dual_traversal_prunes_and_settles(spark):
    """On clustered vectors the traversal drops nearly all node pairs and settles tight clusters without comparing their vectors."""
    r = np.random.default_rng(6)
    x = np.repeat(np.eye(8), 40, 0) + r.normal(size=(320, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, points, kind = cover_tree._points(df, "vec_id", "embedding")
    told, units, vectors = cover_tree.dual(cover_tree.grow(points, kind, 0.316), kind, 0.316)
    rows = told.collect()
    assert sum(t.k for t in rows if t.what == "count") == 8 * 40 and sum(t.what == "own" for t in rows) == 8
    assert units.count() == 0 and vectors.count() == 0 and sum(t.what == "go" for t in rows) <= 8 * 4


def test_near_copies_that_no_leaf_holds(spark):
    """A group whose vectors all link but lie too far apart for one leaf: pairs are told as counts and stars alone."""
    r = np.random.default_rng(9)
    base, noise = r.normal(size=64), r.normal(size=(300, 64))
    x = base / np.linalg.norm(base) + 0.18 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(r.normal(size=(100, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_id((v.vec_id, v.n_links, v.component_id) for v in cover_tree.near_duplicates(df).collect())
    assert got == by_id(vectors_brute(rows)) and max(n for _, n, _ in got) > 250


def test_thresholds_at_the_ends(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=3).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, [2 * v for v in rows[i][1]]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for t in (0.0, 0.5, 0.9999999):
        got = by_id((v.vec_id, v.n_links, v.component_id) for v in cover_tree.near_duplicates(df, threshold=t).collect())
        assert got == by_id(vectors_brute(rows, t))


# ---- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs.toPandas().set_index("doc_id")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.materialize(stage(spark, frames[-1], SF)))
    assert all(f.columns == docs.columns for f in frames[:-1])
    kept, single, clean, mixed, out = frames[1:]
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    _, comp = brute([d.text[i] for i in ids])
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == [ids[k] for k in sorted(set(comp))]
    assert clean.count() == single.count() and clean.where("text rlike '@mail[0-9]'").count() == 0
    sizes = {r.doc_id: r["size"] for r in mixing.with_keys(clean).collect()}
    got = collections.Counter()
    for r in mixing.with_keys(mixed).collect():
        got[r.doc_id] += r["size"]
    assert all(n <= 2 * sizes[i] for i, n in got.items())
    assert abs(sum(got.values()) - sum(r.taken for r in mixing.mix(clean).collect())) == 0
    assert out.count() == mixed.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out.collect()))


def test_one_id_with_several_texts(spark):
    """The texts of an id are one group; reruns keep the same one, and columns of any name pass through."""
    r = random.Random(7)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(60))
    a, b, c = prose(), prose(), prose()
    rows = [(1, a, "x"), (1, b, "x"), (2, b + " end", "x"), (3, c, "x"), (3, c, "x"), (4, prose(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ string")
    found = {(x.doc_id, x.component_id) for x in ngram_join.components(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 4)}
    kept = [sorted(corpus_pipeline.near_duplicates(spark, docs.repartition(k), SF).collect()) for k in (1, 5)]
    assert kept[0] == kept[1] and [x.doc_id for x in kept[0]] == [1, 3, 4] and kept[0][0].text in (a, b) and docs.columns == list(kept[0][0].asDict())


def test_pipeline_edge_cases(spark):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))
    long = prose(200)
    rows = [(1, long, "en", "a", 1, "x"), (1, long, "en", "a", 1, "x"), (None, prose(80), None, None, None, "x"), (3, None, "en", "b", 0, "x"), (4, "", None, "b", 0, "x"), (5, prose(20000), "en", None, 1, "x")]
    docs = spark.createDataFrame(rows, DOCS + ", size string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
    assert docs.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "size"]
    assert {x.doc_id for x in docs.collect()} <= {1, None, 5}
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_columns_of_any_name_survive_every_stage(spark):
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(120))
    names = ["distance", "n_words", "spans", "kept", "n_email", "redacted", "grp", "_given_", "_column5_", "base_failed", "share", "size"]
    rows = [(i, prose() + f" mail{i}@example.org", "en", "s", 1, *[f"{c} {i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join([DOCS, *[f"{c} string" for c in names]]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
        assert docs.columns[5:] == names and all(t == "string" for _, t in docs.dtypes[5:]), name
    got = docs.collect()
    assert got and all(x[c] == f"{c} {x.doc_id}" for x in got for c in names)
    assert all("@" not in x.text for x in got)


def test_copies_without_an_id(spark):
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(60))
    a, b = prose(), prose()
    rows = [(None, a, 1), (None, a, 2), (None, a + " end", 3), (7, b, 4), (None, b, 5), (8, prose(), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == [7, 8] and [x.text[: len(a)] for x in got if x.doc_id is None] == [a]
    assert all((x.doc_id, x.text, x.n_shingles) in rows for x in got)
