"""Normalisation, tokens, ids, chunks and passages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ids, tokens
from palimpsest.functions.textnorm import normalize, normalize_col, paragraphs
from palimpsest.operators import chunks


def one(spark, **values):
    row = {k: v for k, v in values.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def plain_normalize(text):
    lines = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def test_normalize_golden():
    assert normalize(" First   line \r\n still first\r\n\r\n\r\n Second\tparagraph ") == "First line\nstill first\n\nSecond paragraph"
    assert normalize("") == "" and normalize(" \n\t ") == ""
    assert paragraphs("a\n\nbc") == [(0, "a"), (3, "bc")]


def test_normalize_agrees_on_random_texts(spark):
    rng = random.Random(3)
    letters = " \t\n\r\f\vab" + "".join(map(chr, (0x85, 0xA0, 0x1C, 0x1F, 0x2003, 0x2028, 0x3000)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(16))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", normalize_col(F.col("t")).alias("n")).collect():
        assert row.n == plain_normalize(texts[row.i]) == normalize(texts[row.i])


def test_null_text_stays_null(spark):
    df = one(spark, t=None).select(normalize_col(F.col("t")).alias("n"), tokens.tokens(F.col("t")).alias("k"), tokens.token_positions(F.col("t")).alias("p"))
    assert df.first() == (None, None, None)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A quick, brown fox.", [("a", 0, 1), ("quick", 2, 7), ("brown", 9, 14), ("fox", 15, 18)]),
        ("中文文本 reuse", [("中", 0, 1), ("文", 1, 2), ("文", 2, 3), ("本", 3, 4), ("reuse", 5, 10)]),
        ("Straße don't", [("strasse", 0, 6), ("don't", 7, 12)]),
        ("", []),
    ],
)
def test_token_positions(spark, text, expected):
    df = one(spark, id="x", t=text)
    assert [tuple(x) for x in df.select(tokens.token_positions(F.col("t"))).first()[0]] == expected
    rows = tokens.token_table(df, "id", "t").orderBy("pos").collect()
    assert [(r.value, r.start, r.end) for r in rows] == expected


def test_thai_token_ends(spark):
    text = "ภาษาไทย"
    found = one(spark, t=text).select(tokens.token_positions(F.col("t"))).first()[0]
    assert found[0].start == 0 and found[-1].end == len(text)


def test_public_ids(spark):
    kept = ["source-a", "corpus:1", "sample_02"]
    replaced = ["student@example.com", "/private/source.txt", "Essay Draft.docx", "Student-Jane-Doe", "john-smith-paper", "SourceA", "a..b", "report.pdf", "", None]
    df = spark.createDataFrame([(v,) for v in kept + replaced], "v string")
    rows = df.select("v", ids.public_id(F.col("v")).alias("p"), ids.is_public_id(F.col("v")).alias("ok")).collect()
    for r in rows:
        assert r.ok == (r.v in kept)
        assert r.p == (r.v if r.v in kept else "doc:" + hashlib.sha256((r.v or "doc").encode()).hexdigest()[:16])
        assert r.p == ids.public_id_of(r.v)


def test_documents_share_hash_and_id(spark):
    df = spark.createDataFrame([("hello   world",), ("hello world",)], "text string")
    a, b = chunks.documents(df).collect()
    assert a.sha256 == b.sha256 and a.id == b.id == "doc:" + a.sha256[:16]
    assert [(s["index"], s.start, s.end, s.label) for s in a.segments] == [(0, 0, 11, "paragraph 1")]


def test_chunks_golden(spark):
    rows = chunks.chunk(one(spark, k="doc", t="abcdefghij"), "k", "t", 5, 2).orderBy("chunk_index")
    assert [(r.id, r.text, r.start, r.end) for r in rows.collect()] == [("doc:0", "abcde", 0, 5), ("doc:1", "defgh", 3, 8), ("doc:2", "ghij", 6, 10)]
    for bad in ((10, 10), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            chunks.check_window(*bad)


def test_chunks_against_a_plain_model(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n") for _ in range(rng.randrange(120))) for _ in range(200)] + ["", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got: dict = {}
    for r in chunks.chunk(df, "k", "t", 20, 7).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.text))
    for k, text in enumerate(texts):
        norm, expected = normalize(text), []
        for start, para in paragraphs(norm):
            at = 0
            while True:
                window = para[at : at + 20] if len(para) > 20 else para
                body = window.strip()
                if body:
                    s = start + at + len(window) - len(window.lstrip())
                    expected.append((s, s + len(body), body))
                if len(para) <= 20 or at + 20 >= len(para):
                    break
                at += 13
        assert got.get(k, []) == expected
        assert all(norm[s:e] == t for s, e, t in expected)


def test_first_passage_and_obfuscation(spark):
    long = " ".join(f"w{i}" for i in range(100))
    df = one(spark, a="too short", b=long)
    row = df.select(chunks.first_passage(F.col("a")).alias("a"), chunks.first_passage(F.col("b"), 80, 80).alias("b"), chunks.obfuscate(chunks.words(F.col("b"))).alias("o")).first()
    assert row.a is None and row.b == " ".join(long.split()[:80])
    kept = [w for i, w in enumerate(long.split()) if (i + 1) % 9]
    for i in (10, 27, 44, 61, 78):
        kept[i], kept[i + 1] = kept[i + 1], kept[i]
    assert row.o == " ".join(kept)


def test_texts_are_folded_at_once_or_by_token(spark):
    chars = [chr(c) for c in range(0x21, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"Ab{c}Cd X{c}" for c in chars] + ["ΟΔΟΣ Σ ΣΑΣ. ΣΣ", "", None, "Straße İstanbul", "𐐀𐐁 ǅ ﬃ"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    slow = F.transform(F.regexp_extract_all(F.col("text"), F.lit(f"({tokens.TOKEN})"), F.lit(1)), tokens.fold)
    rows = df.select("text", tokens.tokens(F.col("text")).alias("got"), slow.alias("slow")).where(~F.col("got").eqNullSafe(F.col("slow"))).collect()
    assert not rows, [(r.text, r.got, r.slow) for r in rows[:20]]
