"""Exact sequences, lexical scores, fingerprints, corpus scans."""

import hashlib
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fingerprints, scores, tokens
from palimpsest.operators import exact, lexical


def pairs(spark, rows):
    return spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(rows)], "id string, l string, r string")


def test_scores_golden(spark):
    row = lexical.signals(pairs(spark, [("The quick brown fox jumps", "A quick brown fox jumps")]), "l", "r").first()
    assert row.jaccard == pytest.approx(4 / 6) and row.containment == pytest.approx(4 / 5)


def test_identical_and_reordered(spark):
    df = pairs(spark, [("Same short text of five", "Same short text of five"), ("The dog bit the man during the walk.", "The man bit the dog during the walk."), (None, "x"), ("", "")])
    found = lexical.compare_pairs(df, "id", "l", "r", 0.8).collect()
    assert [(r.id, r.kind, r.score) for r in found] == [("0", "exact_overlap", 1.0)]


def test_scored_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 14))), " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for _ in range(400)]
    for limit in (0.0, 0.5, 0.8):
        got = {r.id: r.raw_score for r in lexical.scored(pairs(spark, rows), "l", "r", limit).collect()}
        for i, (a, b) in enumerate(rows):
            x, y = a.split(), b.split()
            order = SequenceMatcher(None, x, y, autojunk=False).ratio()
            contained = len(set(x) & set(y)) / min(len(set(x)), len(set(y)))
            short, long = sorted((a, b), key=len)
            equal = 1.0 if a == b else len(short) / len(long) if len(short) >= 40 and short in long else 0.0
            score = max(equal, contained * order**2)
            assert (str(i) in got) == (score >= limit), (a, b, score)
            if score >= limit:
                assert got[str(i)] == pytest.approx(score)


def plain_spans(a, b, n, most=100):
    grams: dict = {}
    for j in range(len(b) - n + 1):
        grams.setdefault(tuple(b[j : j + n]), []).append(j)
    found = []
    for i in range(len(a) - n + 1):
        for j in grams.get(tuple(a[i : i + n]), []):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            found.append((k, i, j))
    chosen: list = []
    for k, i, j in sorted(found, reverse=True):
        if len(chosen) < most and not any((i < y + x and y < i + k) or (j < z + x and z < j + k) for x, y, z in chosen):
            chosen.append((k, i, j))
    return chosen


def test_exact_spans_equal_a_greedy_loop(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        base = [rng.choice("abc") for _ in range(rng.randrange(4, 40))]
        other = [rng.choice("abc") for _ in range(rng.randrange(4, 40))]
        cut = rng.randrange(len(base))
        rows.append((str(i), " ".join(base), " ".join(other[:5] + base[cut:] + other[5:] + base[: cut + 3])))
    left = spark.createDataFrame([(r[0], r[1]) for r in rows], "a string, text string")
    right = spark.createDataFrame([(r[0], r[2]) for r in rows], "b string, text string")
    found = exact.exact_spans(left, right, "a", "b", n=4, paired=True).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r.match_index):
        got.setdefault(r.a, []).append((r.tokens, r.suspicious_start // 2, r.source_start // 2))
    for key, one, two in rows:
        assert got.get(key, []) == plain_spans(one.split(), two.split(), 4)


def test_tail_of_a_blocked_run_stays_a_candidate(spark):
    a = "p0 p1 p2 p3 " + " ".join(f"s{i}" for i in range(12))
    b = "p0 p1 p2 p3 " + " ".join(f"s{i}" for i in range(4)) + " z " + " ".join(f"s{i}" for i in range(12))
    left, right = (spark.createDataFrame([("1", t)], f"{k} string, text string") for k, t in (("a", a), ("b", b)))
    got = [(r.tokens, r.suspicious_start) for r in exact.exact_spans(left, right, "a", "b", n=4).orderBy("match_index").collect()]
    assert got == [(k, len(" ".join(a.split()[:i])) + (i > 0)) for k, i, _ in plain_spans(a.split(), b.split(), 4)]


def test_exact_span_offsets_and_guard(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota"
    left = spark.createDataFrame([("s", f"Intro. {text}."), (None, None)], "a string, text string")
    right = spark.createDataFrame([("t", f"{text}, and more")], "b string, text string")
    row = exact.exact_spans(left, right, "a", "b", n=5).first()
    assert f"Intro. {text}."[row.suspicious_start : row.suspicious_end] == text and (row.source_start, row.source_end) == (0, len(text))
    with pytest.raises(ValueError):
        exact.grams(left, "a", "text", 0)


def test_cjk_span(spark):
    text = "这是一个用于检测文本复用的中文句子"
    left = spark.createDataFrame([("s", f"{text}。")], "a string, text string")
    right = spark.createDataFrame([("t", f"开头{text}结尾")], "b string, text string")
    row = exact.exact_spans(left, right, "a", "b").first()
    assert f"{text}。"[row.suspicious_start : row.suspicious_end] == text


def plain_simhash(values):
    weights = [0] * 64
    for t, n in Counter(values).items():
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        for b in range(64):
            weights[b] += n if h >> b & 1 else -n
    return sum(1 << b for b in range(64) if weights[b] > 0)


def test_simhash_both_ways(spark):
    texts = ["Alpha beta gamma delta epsilon", "Alpha beta gamma delta zeta", "finance market earnings guidance", "a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    direct = {r.k: r.s & (2**64 - 1) for r in df.select("k", fingerprints.simhash(tokens.tokens(F.col("text"))).alias("s")).collect()}
    table = fingerprints.simhash_table(tokens.token_table(df, "k", "text"), "k", hashed=fingerprints.blake_hash(F.col("value")))
    joined = {r.k: r.simhash & (2**64 - 1) for r in table.collect()}
    assert direct == joined == {i: plain_simhash(t.lower().split()) for i, t in enumerate(texts)}
    assert (direct[0] ^ direct[1]).bit_count() < (direct[0] ^ direct[2]).bit_count()


def test_corpus_scan_equals_plain_scan(spark):
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = {str(i): "\n\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(rng.choice((2, 25)))) for i in range(6)}
    susp = {"x": docs["0"].split("\n\n")[0] + "\n\n" + " ".join(rng.choices(vocabulary, k=12)), "y": docs["3"].split("\n\n")[1]}
    left = spark.createDataFrame(list(susp.items()), "k string, text string")
    right = spark.createDataFrame(list(docs.items()), "d string, text string")
    got = {(r.suspicious_chunk_id, r.source_chunk_id, round(r.raw_score, 9)) for r in lexical.scan_corpus(left, right, "k", "d", min_score=0.3).where("kind <> 'exact_token_sequence'").collect()}
    expected = set()
    for s, text in susp.items():
        for i, c in enumerate(text.split("\n\n")):
            for d, other in docs.items():
                ranked = sorted(((plain_simhash(c.split()) ^ plain_simhash(o.split())).bit_count(), j, o) for j, o in enumerate(other.split("\n\n")))
                for distance, j, o in sorted(ranked, key=lambda x: x[0])[:20]:
                    x, y = c.split(), o.split()
                    value = max(1.0 if c == o else 0.0, len(set(x) & set(y)) / min(len(set(x)), len(set(y))) * SequenceMatcher(None, x, y, autojunk=False).ratio() ** 2)
                    if distance <= 28 and value >= 0.3:
                        expected.add((f"{s}:{i}", f"{d}:{j}", round(value, 9)))
    assert expected and got == expected


def test_candidates_are_those_that_can_reach_the_score(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(400)]
    left = [" ".join(rng.choices(vocabulary, k=rng.choice((2, 9, 40)))) for _ in range(12)] + [""]
    right = [" ".join(rng.choices(vocabulary, k=rng.choice((2, 9, 40)))) for _ in range(60)]
    right += [" ".join(w if rng.random() < 0.85 else rng.choice(vocabulary) for w in t.split()) for t in left] + [t[1:-1] for t in left] + [" ".join(rng.sample(t.split(), len(t.split()))) for t in left]
    table = lambda x, p: spark.createDataFrame([(f"{p}{k}", t) for k, t in enumerate(x)], "id string, text string")
    a, b = table(left, "l"), table(right, "r")
    both = a.select(F.col("id").alias("l_id"), F.col("text").alias("x")).crossJoin(b.select(F.col("id").alias("r_id"), F.col("text").alias("y")))
    needed = {(r.l_id, r.r_id) for r in lexical.scored(both, "x", "y").collect()}
    got = {(r.l_id, r.r_id) for r in lexical.candidate_chunks(a, b, "id").collect()}
    assert needed <= got and len(needed) > 12
    pairs = {(f"l{i}", f"r{k}"): (set(x.split()), set(y.split())) for i, x in enumerate(left) for k, y in enumerate(right)}
    assert all(len(s & t) * 2 >= min(len(s), len(t)) or len(s & t) >= min(len(s), len(t)) - 2 for s, t in map(pairs.get, got))
    shuffled = {(f"l{k}", f"r{len(right) - len(left) + k}") for k, t in enumerate(left) if len(set(t.split())) > 20}
    half = " ".join(f"u{i}" for i in range(20))
    other = half + "".join(f" v{i}" for i in range(18))
    assert shuffled <= got  # a shuffled text has the same counts: only its order can rule it out
    assert lexical.candidate_chunks(table([half], "l"), table([other, other.replace("u", "v", 8)], "r"), "id").count() == 1
    monkeypatch.setattr(lexical, "CHUNKS", 5)
    assert got == {(r.l_id, r.r_id) for r in lexical.candidate_chunks(a, b, "id").collect()}
    assert {(y, x) for x, y in got} == {(r.l_id, r.r_id) for r in lexical.candidate_chunks(b, a, "id").collect()}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="same dimension"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(scores.cosine(F.col("a"), F.col("b"))).collect()
