"""Consistent form, splitting, leakage, packing, residue, language labels."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, leakage, packing, queries, residue, splitting, textform

CYRILLIC_OF = {b: a for a, b in zip(textform.CYRILLIC, textform.LATIN_OF_CYRILLIC)}
ENGLISH = "The office of the fine baffled official: a modest flow, and CHECKED cafés (naïve) in 1999.\n\nAnother façade; so, exactly."
RUSSIAN = "Отчёт из посёлка: с тех пор река сменила русло, а на ней стоит СТАНЦИЯ.\n\nВо всех районах ещё ждут."


def disguises(text, rng):
    yield unicodedata.normalize("NFD", text)
    yield "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rng.random() < 0.5 else c for c in text)
    yield "".join(c + chr(rng.choice((0x200B, 0x200D, 0xAD, 0xFEFF))) if c.isalpha() and rng.random() < 0.2 else c for c in text)
    yield "".join(chr(rng.choice((0xA0, 0x2009, 0x202F))) if c == " " and rng.random() < 0.5 else c for c in text)
    yield text.replace("ffi", chr(0xFB03)).replace("fi", chr(0xFB01)).replace("fl", chr(0xFB02))


def test_look_alikes_come_out_equal():
    rng = random.Random(1)
    for text in (ENGLISH, RUSSIAN):
        for other in disguises(text, rng):
            assert textform.consistent(other) == textform.consistent(text)
    swapped = "".join(CYRILLIC_OF[c] if c in "aceopxysijABCEHKMOPTXS" and rng.random() < 0.7 else c for c in ENGLISH)
    assert swapped != ENGLISH and textform.consistent(swapped) == ENGLISH
    latin = dict(zip(textform.CYRILLIC, textform.LATIN_OF_CYRILLIC))
    swapped = "".join(latin[c] if c in textform.BOTH_WAYS and rng.random() < 0.7 else c for c in RUSSIAN)
    assert swapped != RUSSIAN and textform.consistent(swapped) == RUSSIAN
    for visible in (("cafe", "café"), ("x²", "x2"), ("Word", "word"), ("Straße", "Strasse")):
        assert textform.consistent(visible[0]) != textform.consistent(visible[1])


def test_words_both_ways():
    for text in (ENGLISH, RUSSIAN, "", "x_y don't Ünïted soft" + chr(0xAD) + "ly", "“ab” straße²"):
        assert textform.words(text) == textform._WORD.findall(textform.consistent(text).lower())


def test_look_alike_pairs(spark):
    rows = [(1, "some plain text"), (2, "some plain text"), (3, "some" + chr(0xA0) + "plain text"), (4, "somе plain text"), (5, None), (6, ""), (7, "other"), (None, "some plain text"), (8, "  \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit("clash")).withColumn("id", F.lit("x"))
    full = {tuple(r) for r in textform.look_alike_pairs(docs).collect()}
    assert full == {(1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}
    linked = {tuple(r) for r in textform.look_alike_pairs(docs, full_pairs=1).collect()}
    assert linked < full | {(1, 2)} and {x for p in linked for x in p} == {1, 2, 3, 4}
    assert textform.look_alike_pairs(docs.where("false")).count() == 0
    shown = {r.id: r.form_sha256 for r in textform.consistent_documents(docs.where("doc_id in (1, 3, 5)")).collect()}
    assert shown[1] == shown[3] and shown[5] is None


def test_look_alike_pairs_of_many_copies(spark):
    nbsp, cyrillic = "some" + chr(0xA0) + "plain text", "som" + chr(0x435) + " plain text"
    texts = {i: "some plain text" for i in range(200)} | {200: nbsp, 201: cyrillic, 202: cyrillic}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    expected = {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b]}
    assert {tuple(r) for r in textform.look_alike_pairs(docs).collect()} == expected and {(200, 201), (200, 202), (7, 201)} < expected


def test_split_properties():
    rng = random.Random(3)
    pieces = ["word ", "longerword ", "end. ", "clause, ", "x" * 30 + " ", "y" * 400]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120))).strip()
        limit, overlap = rng.choice(((100, 20), (60, 30), (900, 120)))
        found = splitting.split(text, limit, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text) and all(0 < b - a <= limit for a, b in found)
        for (a, b), (c, d) in zip(found, found[1:]):
            assert 1 <= b - c <= overlap and d > b and c > a
            if text[b - 1].isalnum() and text[b].isalnum():  # inside a word: no blank was near enough
                word = len(text[:b].split()[-1]) + len(text[b:].split()[0])
                assert word > limit - overlap or len(text) > limit
    assert splitting.split("", 10, 2) == [] and splitting.split("abc", 10, 2) == [(0, 3)]
    for bad in ((10, 10), (10, 0)):
        with pytest.raises(ValueError):
            splitting.split("abc", *bad)


def test_cuts_prefer_strong_boundaries():
    text = "alpha beta gamma, delta epsilon zeta. Eta theta iota kappa lambda mu nu"
    assert text[: splitting.split(text, 50, 10)[0][1]] == "alpha beta gamma, delta epsilon zeta. "


def test_oversized_paragraphs(spark):
    text = "short\n\n\n\n" + "many words here. " * 80 + "\n\nend"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 900), (5, "x" * 901), (1, text)], "doc_id bigint, text string").withColumn("piece", F.lit(1))
    assert {tuple(r) for r in splitting.must_be_cut(docs).collect()} == {(1, 1), (5, 0)}
    from palimpsest.functions.textnorm import normalize

    for r in splitting.oversized_pieces(docs).where("id = 1").collect():
        assert normalize(text)[r.start_char : r.end_char] == r.piece and len(r.piece) <= 900


def test_suffix_array():
    rng = np.random.default_rng(4)
    for _ in range(50):
        seq = rng.integers(0, 4, rng.integers(1, 60))
        order = leakage.suffix_array(seq, 8)
        keys = [tuple(np.concatenate((seq[i : i + 8] + 1, np.zeros(8, int)))[:8]) for i in order]
        assert keys == sorted(keys)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(8)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 20)))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for i in range(120):
        words = rng.choices([*vocabulary, "Unknown"], k=rng.randrange(0, 40))
        if i % 3 == 0:
            words[5:5] = items[rng.randrange(30)][1].upper().split()
        docs.append((i, rng.choice((" ", ", ", "\n")).join(words)))
    docs += [(500, None), (3, docs[3][1])]
    got = {(r.id, r.item_id): r.n_words for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x")), spark.createDataFrame(items, "item_id bigint, text string"), least=5).collect()}
    expected = {}
    for d, text in docs:
        have = textform.words(text or "")
        for i, item in items:
            want = textform.words(item or "")
            best = 0
            for a in range(len(have)):
                for b in range(len(want)):
                    n = 0
                    while a + n < len(have) and b + n < len(want) and have[a + n] == want[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= 5:
                expected[d, i] = best
    assert got == expected and expected


def test_leaks_of_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    found = leakage.leaks(docs, items)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 0, 10)]
    assert leakage.leaks(docs.where("false"), items).count() == leakage.leaks(docs, items.where("false")).count() == 0
    assert leakage.without_leaks(docs, found).count() == 0


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice((None, 0, 3, 500, 512, 513, 1500, rng.randrange(1, 512)))) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "id bigint, tokens int")
    for tasks in (1, 9):
        packed = packing.pack(sizes, tasks=tasks).collect()
        fill, per_item = {}, {}
        for r in packed:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            per_item.setdefault(r.id, []).append(r.tokens)
        assert max(fill.values()) <= 512 and set(per_item) == {i for i, _ in rows}
        for i, n in rows:
            assert sum(per_item[i]) == (n or 0) and (len(per_item[i]) == 1 or n > 512)
        least = -(-sum(fill.values()) // 512)
        assert len(fill) <= 1.05 * least + tasks
    report = packing.report(packing.pack(sizes)).first()
    assert report.fullest == 512 and report.unused < 0.05
    assert packing.pack(sizes.where("false")).count() == 0
    with pytest.raises(Exception, match="negative"):
        packing.pack(spark.createDataFrame([(1, -1)], "id bigint, tokens int")).collect()


def test_best_fit_is_tight():
    sizes = np.array([300, 200, 12, 512, 100, 400, 112])
    bins = packing.best_fit(sizes)
    assert sorted(np.bincount(bins, sizes)) == [100, 512, 512, 512]


def held(text):
    field, blocks = residue.pieces(text)
    return field or any(any(residue.seeds(block, alone)) for block, alone in blocks)


def test_residue_rules_and_decoys():
    for text in (
        "Dear {{ first_name }}, welcome", "seasonal runoff «term» near", "[INSERT TITLE HERE]", "Lorem ipsum dolor sit amet, elit sed.", "Error 404: page not found", "Please enable JavaScript to read this text", "xx xx xx", "bla bla bla bla 12ab34cd56",
        "The article you asked for could not be found.", "Your account has been suspended.", "Die Datei wurde gelöscht", "Votre session a expiré.", "El archivo ya no existe", "O servidor não responde.", "Сервер не отвечает", "Dienstfehler: Fehler 503", "Bitte Skripte zulassen", "HTTP 502 Bad Gateway",
    ):
        assert held(text), text
    for text in (
        "Visitors who reached a missing page were counted separately in 1990.", "The handbook explains why readers without JavaScript saw a shorter menu at Praby.", "Les lecteurs de «Hilor» ont signalé 20 pages.", "Prices of $13 to $20 per volume.", "The set { 15, 8, 1996 } is used.", "An appendix counts how often the server answered with status 404.",
        "The Rineth site tracks the cost of delayed maintenance before the gauges were moved.", "Уточнённый расчёт подтверждает неравный доступ к колодцам, до закрытия перечня.", "He waited. " * 9 + "The connection was lost. Nobody came back that night, and the office stayed dark.",
    ):
        assert not held(text), text


def test_filler_of_ordinary_text():
    usual = "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
    for text in (*usual.split(". "), "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas"):
        assert held(text), text
    for text in ("Est-ce que le lac est encore libre?", "Sed non satiata is a poem of 1857", "In vitae patrum the monks are named", "a in id at do"):
        assert not held(text), text


def test_failures_are_searched_where_a_thing_is_named(monkeypatch):
    for text in ("die datenbank und der mitgliederdienst sind nicht erreichbar", "мы видели что страницы удалены", "nothing lives here", "the river was lost"):
        assert residue.failure(text) == bool(residue._ADDRESSED.match(text) or any(f.search(text) for f in residue._FAILED)), text
    monkeypatch.setattr(residue, "_NAMED", tuple((named, parts, None) for named, parts, _ in residue._NAMED))
    assert not residue.failure("the links of the river were lost and removed")  # no pattern is searched, or None would fail
    with pytest.raises(AttributeError):
        residue.failure("the link was removed")


def test_expiry_notices_are_seeds_of_any_length():
    rest = ", so all that you had entered on the pages before this one is lost and has to be entered once more from the beginning"
    for text in ("Your session has timed out", "Ihre Sitzung ist abgelaufen", "Votre session a expiré", "Su enlace ha caducado", "A sua sessão expirou", "Ваша сессия истекла"):
        assert residue.trusted(residue.masked(text + rest)), text
    for text in ("The link has expired", "Your lease has expired", "Your link to the coast expired in our minds", "Your sessions expired"):
        assert not residue.trusted(residue.masked(text + rest)), text


def test_labels_spread_through_near_duplicates(spark):
    seed = "Please enable JavaScript to read this very particular notice of the archive reading room"
    near = "Plaese enabel JavaScript to read this very particular notice of the archive reading room"
    far = near.replace("reading room", "reading rooms").replace("very", "quite a")
    rows = [(1, f"A text.\n{seed}. 12345678ab"), (2, f"Some words first. {near}"), (3, far), (4, "An ordinary sentence about the reading room at the old harbour office"), (5, None), (6, ""), (1, f"A text.\n{seed}. 12345678ab")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("seed", F.lit(1)).withColumn("h", F.lit(2))
    found = {r.id: r.spread_pieces for r in residue.residue(docs).collect()}
    assert not residue.trusted(residue.masked(near)) and found == {1: 0, 2: 1, 3: 1}
    assert residue.residue(docs.where("false")).count() == 0
    assert {r.doc_id for r in residue.without_residue(docs, residue.residue(docs)).collect()} == {4, 5, 6}


def test_labels_spread_through_messages(spark):
    rows = [
        (1, "Error 404. Kindly walk back to the desk"), (2, "Page not found. Kindly walk back to the desk"), (3, "Kindly walk back to the desk"), (4, "Error 500. This stands beside one only"), (5, "This stands beside one only"),
        (6, "Error 404. A sentence of many texts"), (7, "Error 500. A sentence of many texts"), *((k, f"A sentence of many texts. And number {chr(60 + k)} of it follows") for k in range(8, 13)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.id for r in residue.residue(docs).collect()} == {1, 2, 3, 4, 6, 7}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    words = "the page you asked for could not be found on this server because it was moved by our office last year".split()
    front = [" ".join(rng.choices(words, k=rng.randrange(3, 16))) for _ in range(40)]
    texts = []
    for text in front * 6:
        other = list(text)
        for _ in range(rng.randrange(1, 2 + len(text) // 4)):
            k = rng.randrange(len(other))
            other[k : k + rng.randrange(2)] = rng.choice(("", "x", "e", " "))
        texts.append("".join(other))
    table = lambda x: spark.createDataFrame([(k, t, bytearray(s)) for k, (t, s) in enumerate(zip(x, residue.simhashes(x)))], "h bigint, piece string, simhash binary")
    long = lambda x: [t for t in x if len(t) >= residue.SHORTEST]  # noqa: E731 - shorter ones have no near-duplicates
    expected = {t for t in long(texts) if any(5 * edit_distance(t, f) <= max(len(t), len(f)) for f in long(front))}
    left, right = table(texts), table(front)
    got = {r.piece for r in residue.verified(residue.met_pairs(left, right, len(front)), left, right).collect()}
    assert got <= expected and len(got) >= 0.93 * len(expected) and len(expected) < len(set(texts))


def test_no_pair_of_few_different_bits_is_missed(spark):
    rng = random.Random(3)
    words = "the page you asked for could not be found on this server because it was moved by our office last year".split()
    front = [" ".join(rng.choices(words, k=rng.randrange(3, 16))) for _ in range(60)]
    texts = []
    for text in front * 12:
        other = list(text)
        for _ in range(rng.randrange(1, 2 + len(text) // 6)):
            other[rng.randrange(len(other))] = rng.choice("xeq ")
        texts.append("".join(other))
    marks = {t: np.frombuffer(m, np.uint64) for t, m in zip(front + texts, residue.simhashes(front + texts))}
    alike = lambda a, b: np.bitwise_count(marks[a] ^ marks[b]).sum() <= residue.HAMMING and 5 * edit_distance(a, b) <= max(len(a), len(b))
    expected = {(i, k) for i, t in enumerate(texts) for k, f in enumerate(front) if len(t) >= residue.SHORTEST <= len(f) and abs(len(t) - len(f)) * 5 <= max(len(t), len(f)) and alike(t, f)}
    table = lambda x: spark.createDataFrame([(k, t, bytearray(s)) for k, (t, s) in enumerate(zip(x, residue.simhashes(x)))], "h bigint, piece string, simhash binary")
    got = {(r.h, r.f) for r in residue.met_pairs(table(texts), table(front), len(front)).collect()}
    assert expected <= got and len(expected) > 600


def test_copies_are_cut_once(spark, monkeypatch):
    rows = [(k, text) for k, text in enumerate(["Error 404. Go back", "A text of its own", "{{ title }} of a form", None, ""] * 8)] + [(1, "Error 404. Go back"), (0, "Error 404. Go back"), (0, "Page not found"), (None, "Error 404. Go back")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, copies = residue.one_of_each(docs)
    assert copies is not None and one.distinct().count() == 4 and copies.count() == 27
    found = {tuple(r) for r in residue.residue(docs).collect()}
    monkeypatch.setattr(residue, "COPIES", 1.0)
    assert residue.one_of_each(docs)[1] is None
    assert found == {tuple(r) for r in residue.residue(docs).collect()} and {r[0] for r in found} == {k for k in range(40) if k % 5 in (0, 2)} | {1}


def test_pairs_that_meet_have_like_counts(spark):
    rng = random.Random(5)
    words = "the page you asked for could not be found on this server because it was moved by our office last year".split()
    front, texts = ([" ".join(rng.choices(words, k=12)) for _ in range(n)] for n in (30, 300))
    texts += [t[:20] + "x" + t[22:40] + t[41:] for t in front]
    table = lambda x: spark.createDataFrame([(k, t, bytearray(s)) for k, (t, s) in enumerate(zip(x, residue.simhashes(x)))], "h bigint, piece string, simhash binary")
    pairs = {(r.h, r.f) for r in residue.met_pairs(table(texts), table(front), len(front)).collect()}
    assert {(300 + k, k) for k in range(30)} <= pairs
    grams = lambda t: Counter(a + b for a, b in zip(f" {t}", f"{t} "))
    for h, f in pairs:  # an edit changes one character and two bigrams
        a, b = texts[h], front[f]
        edits = max(len(a), len(b)) // 5
        assert max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) <= edits + 3
        assert max((grams(a) - grams(b)).total(), (grams(b) - grams(a)).total()) <= 2 * edits + 8
    assert residue.bags(["ab", ""]).sum(1).tolist() == [7, 3]



def test_labels_reach_all_of_the_similarity(spark):
    seed = "Your link has expired, so the page you asked for could not be found on this server"
    near = "The old link has expired, so the page you requested could not be found on this server"
    a, b = residue.masked(seed), residue.masked(near)
    assert residue.trusted(a) and not residue.trusted(b) and 0.8 <= 1 - edit_distance(a, b) / len(b) < 0.85
    docs = spark.createDataFrame([(1, seed), (2, near), (3, "The old server was found in the office, so the page was moved")], "doc_id bigint, text string")
    assert {r.id for r in residue.residue(docs).collect()} == {1, 2}


SENTENCES = {
    "en": "the river changed its course and the report was never closed because the records were incomplete",
    "de": "der fluss änderte seinen lauf und der bericht wurde nie geschlossen weil die akten unvollständig waren",
    "fr": "la rivière a changé de lit et le rapport n'a jamais été clos parce que les notices étaient incomplètes",
    "es": "el río cambió de curso y el informe nunca se cerró porque los registros estaban incompletos",
    "pt": "o rio mudou de curso e o relatório nunca foi fechado porque os registos não estavam completos",
    "ru": "река сменила русло и отчёт так и не закрыли потому что записи были неполными и старыми",
}


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(9)
    texts, labels = [], []
    for k, code in enumerate(language.LANGUAGES):
        for _ in range(40):
            words = SENTENCES[code].split()
            rng.shuffle(words)
            texts.append(language.prepared(" ".join(words * 3)))
            labels.append(k if rng.random() > 0.1 else 0)
    return language.Network().train(texts, np.array(labels), rounds=220)


def test_gradients_are_those_of_the_loss():
    net = language.Network()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    blocks, mask = language._blocks([b"some bytes of a text", b"and another, longer piece of text"])
    grams, target = net.grams(blocks), np.array([0, 3])
    grad = net.gradients(grams, mask.astype(np.float64), target)

    def loss():
        p = net.forward(grams, mask)
        return -(np.log(p[np.arange(2)[:, None], np.arange(p.shape[1]), target[:, None]]) * mask).sum() / mask.sum()

    for name, w in net.weights.items():
        place = (int(grams[0, 0, 0]), 1) if name == "gram" else tuple(0 for _ in w.shape)
        old, values = w[place], []
        for step in (1e-3, -1e-3):
            w[place] = old + step
            values.append(loss())
        w[place] = old
        assert (values[0] - values[1]) / 2e-3 == pytest.approx(grad[name][place], rel=0.1, abs=2e-4)


def test_sums_of_the_forward_pass(trained):
    rng = random.Random(4)
    texts = [language.prepared(" ".join(rng.choices(SENTENCES[rng.choice(language.LANGUAGES)].split(), k=rng.randrange(60)))) for _ in range(50)] + [b"", b"x"]
    blocks, mask = language._blocks(texts)
    grams = trained.grams(blocks)
    assert np.allclose(trained.summed(grams, mask), (trained.forward(grams, mask) * mask[:, :, None]).sum(1), atol=1e-4)


def test_records_are_decided_as_if_alone(trained):
    records = [[], [SENTENCES["de"]], ["12", "34"], [SENTENCES["en"], SENTENCES["ru"], "5"], [SENTENCES["fr"], "le"], []]
    got = language.decided_all(records, trained)
    assert [len(rows) for rows, _ in got] == [0, 1, 0, 3, 1, 0] and [mixed for _, mixed in got] == [False, False, False, True, False, False]
    for record, (rows, mixed) in zip(records, got):
        alone = language.decided(record, trained)
        assert alone[1] == mixed and [(*r[:2], round(r[2], 4)) for r in alone[0]] == [(*r[:2], round(r[2], 4)) for r in rows]


def test_language_of_documents_and_segments(spark, trained):
    mixed = SENTENCES["en"] + "\n\n" + SENTENCES["ru"] + "\n\n1234"
    rows = [(1, SENTENCES["de"], "English"), (2, SENTENCES["de"], "de-AT"), (3, mixed, "en"), (4, SENTENCES["ru"], None), (5, None, "en"), (6, "", "en"), (7, "12 34", "en"), (8, SENTENCES["fr"] + " the river", "??")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("segment", F.lit("x"))
    found = language.to_correct(language.label_documents(docs, trained)).select("rec_id", "segment", "lang").collect()
    assert {tuple(r) for r in found} == {("1", -1, "de"), ("3", 0, "en"), ("3", 1, "ru"), ("3", 2, "en"), ("4", -1, "ru"), ("8", -1, "fr")} or {tuple(r) for r in found if r.rec_id != "3" or r.segment < 2} == {("1", -1, "de"), ("3", 0, "en"), ("3", 1, "ru"), ("4", -1, "ru"), ("8", -1, "fr")}
    pairs = spark.createDataFrame([("a", SENTENCES["en"], SENTENCES["es"], {"language": "en"}), ("b", SENTENCES["en"], None, {"language": "EN"}), ("c", None, None, None)], "id string, left_text string, right_text string, metadata map<string,string>")
    got = {tuple(r) for r in language.to_correct(language.label_pairs(pairs, trained)).select("rec_id", "segment", "lang").collect()}
    assert got == {("a", 0, "en"), ("a", 1, "es")}
    assert language.label_documents(docs.where("false"), trained).count() == 0


def test_labels_made_in_the_piece_pass(spark, trained):
    mixed = SENTENCES["en"] + "\n\n" + SENTENCES["ru"]
    rows = [(1, SENTENCES["de"], "English"), (2, mixed, "en"), (3, "Error 404\n\n" + SENTENCES["fr"], None), (None, SENTENCES["es"], "es"), (5, None, "en"), (6, "", "en"), (7, "12 34", "en"), (8, "{{ title }}", "en"), (1, SENTENCES["de"], "English")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    both = residue.piece_rows(docs, extra=(language.named(F.col("lang")).alias("code"),), beside=language.form_labeller(trained), schema=language.SCHEMA)
    names = ["rec_id", "segment", "lang", "mixed", "label"]
    got = sorted(map(tuple, both.where("rec_id is not null").select(names).collect()), key=str)
    assert got == sorted(map(tuple, language.label_documents(docs, trained).select(names).collect()), key=str) and len(got) == 6
    assert {tuple(r) for r in residue.residue_of(both).collect()} == {tuple(r) for r in residue.residue(docs).collect()} == {(3, False, 1, 0), (8, True, 1, 0)}


def test_copies_are_labelled_once_with_their_own_labels(spark, trained, tmp_path, monkeypatch):
    texts = [SENTENCES["de"], SENTENCES["en"] + "\n\n" + SENTENCES["ru"], "Error 404\n\n" + SENTENCES["fr"], None, ""]
    rows = [(k, texts[k % 5], ("de", "en", None, "English", "??")[k % 4]) for k in range(40)] + [(1, texts[1], "ru"), (2, texts[0], "de"), (None, texts[0], "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", SENTENCES["en"], SENTENCES["es"], {"language": "en"})], "id string, left_text string, right_text string, metadata map<string,string>").write.parquet(f"{tmp_path}/pair_examples.parquet")
    monkeypatch.setattr(language, "fit", lambda docs: trained)
    cut = []
    pass_of = residue.piece_rows
    monkeypatch.setattr(residue, "piece_rows", lambda docs, *a, **b: cut.append(docs.count()) or pass_of(docs, *a, **b))
    plain = lambda df: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}
    found = plain(queries.p6_labels(spark, str(tmp_path)))
    monkeypatch.setattr(residue, "COPIES", 1.0)
    assert found == plain(queries.p6_labels(spark, str(tmp_path))) and len(found) > 20 and cut[0] < 8 < cut[1]
