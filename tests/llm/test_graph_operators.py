"""Near copies, neighbours, shared spans, components: against brute force, with skew and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import components, nearcopies, neighbours, sharedspans
from palimpsest.llm.textform import words


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def edited(text, rng, edits):
    out = text.split()
    for _ in range(edits):
        k = rng.randrange(len(out))
        rng.choice((lambda: out.pop(k), lambda: out.insert(k, f"n{rng.randrange(9999)}"), lambda: out.__setitem__(k, "changed")))()
    return " ".join(out)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = " ".join(rng.choices(vocabulary, k=rng.randrange(42, 300)))
        rows += [(10 * i, base), (10 * i + 1, edited(base, rng, 2)), (10 * i + 2, edited(base, rng, 12))]
        if i % 5 == 0:
            rows.append((10 * i + 3, base.upper()))
    rows += [(9001, None), (9002, ""), (9003, "too short a text"), (None, rows[0][1]), rows[0]]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("t")).withColumn("cls", F.lit("x"))
    members, pairs = nearcopies.near_copies(df, 0.6, 40)
    got = {(r.id_a, r.id_b) for r in nearcopies.record_pairs(members, pairs).collect()}
    texts = {i: words(t) for i, t in rows if i is not None and t and len(words(t)) >= 40}
    ids = sorted(texts)
    expected = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(texts[a], texts[b]) >= 0.6}
    assert got == expected and len(expected) > 60
    classes = {r.id: r for r in nearcopies.record_classes(members, pairs).collect()}
    assert set(classes) == set(ids) and classes[3].class_id == 0 and classes[3].copies == 2
    none = nearcopies.near_copies(df.where("false"), 0.6, 40)
    assert none[0].count() == none[1].count() == 0


def test_a_large_group_of_copies_stays_linear(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(300)] + [(1000, text + " and a few more words")]
    members, pairs = nearcopies.near_copies(spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("t")), 0.6, 40)
    found = {tuple(r) for r in nearcopies.record_pairs(members, pairs).select("id_a", "id_b").collect()}
    assert found == {(0, i) for i in range(1, 300)} | {(0, 1000)}


def test_hot_cells_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE", 8)
    rng = random.Random(2)
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(i, edited(base, rng, 2)) for i in range(40)]
    members, pairs = nearcopies.near_copies(spark.createDataFrame(rows, "id bigint, text string").withColumn("tbl", F.lit("t")), 0.6, 40)
    got = {(r.id_a, r.id_b) for r in nearcopies.record_pairs(members, pairs).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if jaccard(rows[a][1].split(), rows[b][1].split()) >= 0.6}


def test_rtree_keeps_every_pair_within_the_bound():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (200, 64)).astype(np.uint16)
    points[100:] = np.clip(points[:100].astype(int) + rng.integers(-1, 2, (100, 64)), 0, 9)
    size = points.sum(1).astype(np.int64)
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in nearcopies.RTree(points, size).join(0.6)))}
    for a in range(200):
        for b in range(a + 1, 200):
            allowed = np.minimum(points[a], points[b]).sum() >= np.ceil(0.375 * (size[a] + size[b]) - 1e-9)
            assert ((a, b) in got) == allowed


def plain_neighbours(vectors, least=0.85, k=5):
    ids = sorted(vectors)
    unit = np.array([vectors[i] for i in ids])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -2)
    out = set()
    for a in range(len(ids)):
        near = np.flatnonzero(sims[a] >= least)
        for b in near[np.lexsort((near, -sims[a][near]))][:k]:
            out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    vectors = {f"r{i:04d}": (centres[i % 40] + 0.35 * rng.standard_normal(64)) * rng.uniform(0.01, 50) for i in range(900)}
    for i in range(100):
        vectors[f"s{i:04d}"] = vectors["r0000"] * 2.0  # a group of one direction
    rows = [(k, [float(x) for x in v], "2024-01-02") for k, v in vectors.items()]
    rows += [("r0001", [1.0] * 64, "2024-01-01"), ("bad1", None, "2024-01-01"), ("bad2", [0.0] * 64, None), ("bad3", [float("nan")] * 64, None), ("bad4", [1.0] * 3, None), (None, [1.0] * 64, None), rows[0], ("gone", [1.0] * 64, "2024-01-01"), ("gone", None, "2024-01-03"), ("bad5", [None] * 64, None)]
    df = spark.createDataFrame(rows, "id string, vector array<double>, t string").withColumn("upserted_at", F.col("t").cast("timestamp")).withColumn("cls", F.lit(1))
    for shard in (8192, 200, 8):  # one graph; some; so many that their centroids are grouped
        found = neighbours.neighbour_pairs(df, shard=shard)
        got = {tuple(r) for r in neighbours.linked(found).collect()}
        expected = plain_neighbours(vectors)
        assert len(got & expected) >= 0.97 * len(expected) and len(got) <= 1.03 * len(expected)
        cells = neighbours.Cells(np.array(list(vectors.values())), -(-941 // shard))
        assert len(cells.top) == (10 if shard == 8 else 1)
        copies = {r.neighbour for r in found.where("id = 's0050'").collect()}
        assert copies == {"r0000", "s0000", "s0001", "s0002", "s0003"}
    assert neighbours.neighbour_pairs(df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 64)).astype(np.float32)
    vectors[1500:] = vectors[:1500] + 0.4 * rng.standard_normal((1500, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids, _ = neighbours.Graph.build(vectors).search(vectors[:500])
    true = (vectors[:500] @ vectors.T).argsort(1)[:, ::-1][:, :2]
    assert np.mean([len(set(a[:2]) & set(b)) / 2 for a, b in zip(ids, true)]) >= 0.9
    one = neighbours.Graph.build(vectors[:1])
    assert one.search(vectors[:2])[0][:, 0].tolist() == [0, 0]


def plain_shared(docs, least):
    runs = set()
    for d, text in docs:
        marked = [False] * len(text)
        for s in range(len(text) - least + 1):
            if any(o != d and text[s : s + least] in other for o, other in docs):
                marked[s : s + least] = [True] * least
        at = 0
        while at < len(text):
            if marked[at]:
                end = at
                while end < len(text) and marked[end]:
                    end += 1
                runs.add((d, at, end))
                at = end
            else:
                at += 1
    return runs


def test_shared_spans_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    letters = "abcdefghé ж"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = [piece(n) for n in (239, 240, 241, 400, 700)]
    docs = [(i, piece(rng.randrange(50)) + rng.choice(common) + piece(rng.randrange(60)) + rng.choice(common)[: rng.randrange(200, 400)] + piece(20)) for i in range(24)]
    docs += [(100, docs[0][1]), (101, piece(300) + common[3] + common[3])]
    rows = [*docs, (102, None), (103, ""), (None, docs[0][1]), docs[1]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gram", F.lit("x")).withColumn("id", F.lit("y"))
    expected = plain_shared(docs, 240)
    assert {tuple(r) for r in sharedspans.shared_spans(df).collect()} == expected and expected
    monkeypatch.setattr(sharedspans, "HOT_CHARS", 1)  # every group takes the way of frequent passages
    spans = sharedspans.shared_spans(df)
    assert {tuple(r) for r in spans.collect()} == expected
    amounts = {r.id: r.shared for r in sharedspans.shared_amounts(df.where("doc_id is not null").distinct(), spans).collect()}
    assert amounts[100] == sum(b - a for d, a, b in expected if d == 100) and amounts[102] == 0
    assert sharedspans.shared_spans(df.where("false")).count() == 0


def test_windows_of_a_shard(monkeypatch):
    monkeypatch.setattr(sharedspans, "LEAST", 6)
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(1, 8)
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(n)]
        owners, several = [rng.randrange(3) for _ in range(n)], [rng.random() < 0.15 for _ in range(n)]
        for i, found in enumerate(sharedspans.shared_windows(texts, owners, several)):
            merged: list = []
            for s in range(len(texts[i]) - 5):
                if several[i] or any((owners[j] != owners[i] or several[j]) and texts[i][s : s + 6] in texts[j] for j in range(n)):
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], s + 6)
                    else:
                        merged.append((s, s + 6))
            assert found == merged


def test_components(spark):
    rng = random.Random(9)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(0, 60)]  # a chain
    edges += [("hub", f"leaf{i}") for i in range(200)] + [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(120)]
    edges += [(" C0 ", "c0"), ("X", None), ("", "y"), ("  ", "z"), (None, None), ("c5", "C6"), ("c6", "c5"), ("self", " SELF")]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "suspicious_chunk_id string, source_chunk_id string").withColumn("id", F.lit(1)).withColumn("a", F.lit(2))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = (a or "").strip().lower(), (b or "").strip().lower()
        if a and b and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.groups(df).collect()))
    assert got == {x: root(x) for x in list(parent)}
    assert components.groups(df.where("false")).count() == 0
    assert components.groups(df.where("source_chunk_id is null")).count() == 0
