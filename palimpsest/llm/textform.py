"""One consistent form for texts that look the same (problem 5), and the words made from it.

The script of every token is resolved by intersecting the script sets of its letters: a letter
with a look-alike in another script belongs to both. A token whose intersection is one script is
spelled in that script; one that fits both (a whole-script confusable) takes the script of the
nearest token that fits only one, on its line if possible; one that fits none (it mixes letters
that have no look-alike) is spelled letter by letter after its nearest unambiguous letter. Each
decision depends on what the token looks like, not on the characters it holds, so texts that
look the same come out equal. Width forms, ligatures, invisible characters, kinds of space and
combining accents are normalised as well; raised digits, letter case and accents are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import product

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.textnorm import normalize
from palimpsest.plans.tables import materialize

# Letters of two scripts that are drawn alike, Cyrillic / Latin.
CYRILLIC = "АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһӏ"
LATIN_OF_CYRILLIC = "ABEKMHOPCTYXSIJaeopcyxsijdqwhl"
# Greek / Latin.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
LATIN_OF_GREEK = "ABEZHIKMNOPTYXocj"
# Of the Cyrillic ones, those of the Russian alphabet: only they are spelled back in a Cyrillic word.
BOTH_WAYS = "АВЕКМНОРСТУХаеорсух"

TO_LATIN = {ord(a): b for a, b in zip(CYRILLIC + GREEK, LATIN_OF_CYRILLIC + LATIN_OF_GREEK)}
TO_CYRILLIC = {ord(b): a for a, b in zip(CYRILLIC, LATIN_OF_CYRILLIC) if a in BOTH_WAYS}
_AMBIGUOUS = {chr(c) for c in TO_CYRILLIC}  # as spelled in Latin

# Code points that take no room, and kinds of space, as inclusive ranges.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
SPACES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
LINE_ENDS = ((0x2028, 0x2029),)
COMPATIBLE = ((0xFB00, 0xFB06), (0xFF01, 0xFFEE))  # ligatures and width forms
MARKS = ((0x300, 0x36F), (0x1E00, 0x1EFF), (0x2126, 0x2126), (0x212A, 0x212B), (0xF900, 0xFAFF))
FOREIGN = ((0x370, 0x52F), (0x1F00, 0x1FFF))
LATIN_OR_GREEK = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x370, 0x3FF), (0x1E00, 0x1FFF))


def _class(*ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for group in ranges for a, b in group) + "]"


def _forms() -> dict[int, str | None]:
    """Width forms and ligatures as the Unicode tables decompose them; invisible characters and spaces."""
    out: dict[int, str | None] = {}
    for a, b in COMPATIBLE:
        for code in range(a, b + 1):
            if unicodedata.decomposition(chr(code)).startswith(("<wide>", "<narrow>", "<compat>")):
                out[code] = unicodedata.normalize("NFKC", chr(code))
    for ranges, to in ((INVISIBLE, None), (SPACES, " "), (LINE_ENDS, "\n")):
        for a, b in ranges:
            out |= dict.fromkeys(range(a, b + 1), to)
    return out


FORMS = _forms()
_FORM = re.compile(_class(INVISIBLE, SPACES, LINE_ENDS, COMPATIBLE))
_MARK = re.compile(_class(MARKS))
_FOREIGN = re.compile(_class(FOREIGN))
_LATIN_OR_GREEK = re.compile(_class(LATIN_OR_GREEK))
_SURE_CYRILLIC = re.compile("[" + "".join(x for x in map(chr, range(0x410, 0x450)) if ord(x) not in TO_LATIN) + "]")
_TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|" + _class(MARKS[:1]) + ")*|\n")
_WORD = re.compile(r"[^\W_]+")


def _script(letter: str) -> str:
    """L, C, G, '?' for a letter of another script, '' for either Latin or Cyrillic."""
    if letter in _AMBIGUOUS:
        return ""
    code = ord(letter)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "L"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    return "C" if 0x400 <= code < 0x530 else "?"


def _resolve(token: str) -> tuple[str, str]:
    """(script, spelling); script is '' if the token fits Latin and Cyrillic, spelling is Latin then."""
    token = unicodedata.normalize("NFD", token)
    skeleton = token.translate(TO_LATIN)
    scripts = [_script(x) for x in skeleton if not unicodedata.combining(x)]
    sure = {s for s in scripts if s}
    if not sure:
        return "", skeleton
    if sure == {"L"}:
        return "L", skeleton
    if sure == {"C"}:
        return "C", skeleton.translate(TO_CYRILLIC)
    if "L" not in sure and "C" not in sure:
        return "?", token
    if len(skeleton) != len(scripts):
        return "?", skeleton
    out = []
    for i, letter in enumerate(skeleton):  # after the nearest letter that has one script, the left one first
        near = scripts[i] or next(scripts[j] for d, s in product(range(1, len(scripts)), (-1, 1)) if 0 <= (j := i + s * d) < len(scripts) and scripts[j])
        out.append(letter.translate(TO_CYRILLIC) if near == "C" else letter)
    return "?", "".join(out)


_known: dict[str, tuple[str, str]] = {}


def _letters(text: str) -> str:
    tokens = list(_TOKEN.finditer(text))
    kinds = []
    for m in tokens:
        if (word := m[0]) == "\n":
            kinds.append(("\n", word))
            continue
        found = _known.get(word)
        if found is None:
            if len(_known) > 200_000:
                _known.clear()
            found = _known[word] = _resolve(word)
        kinds.append(found)
    votes = Counter(k for k, _ in kinds if k in ("L", "C"))
    most = "C" if votes["C"] > votes["L"] else "L"
    before: list[str] = []
    last = ""
    for k, _ in kinds:
        last = "" if k == "\n" else k if k in ("L", "C") else last
        before.append(last)
    out, at, after = [], len(text), ""
    for i in range(len(tokens) - 1, -1, -1):
        k, word = kinds[i]
        if k == "\n":
            after = ""
        elif k in ("L", "C"):
            after = k
        elif k == "" and (before[i] or after or most) == "C":
            word = word.translate(TO_CYRILLIC)
        out += (text[tokens[i].end() : at], word)
        at = tokens[i].start()
    out.append(text[:at])
    return "".join(reversed(out))


def _common(text: str) -> bool:
    """Whether a text has only Latin-1 characters of which none needs a change."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return b"\xa0" not in plain and b"\xad" not in plain


def consistent(text: str) -> str:
    """The consistent form of a text; whitespace is normalised too."""
    if not (text.isascii() or _common(text)):
        if _FORM.search(text):
            text = text.translate(FORMS)
        marked = _MARK.search(text) is not None
        if marked:
            text = unicodedata.normalize("NFC", text)
        if _FOREIGN.search(text) and (_LATIN_OR_GREEK.search(text) or not _SURE_CYRILLIC.search(text)):
            text = _letters(text)
            marked = True
        if marked:
            text = unicodedata.normalize("NFC", text)
    return normalize(text)


def _latin_table() -> bytes:
    """Latin-1 letters and digits in lower case, everything else as a blank."""
    return bytes(ord(x.lower()) if _WORD.fullmatch(x := chr(c)) else 32 for c in range(256))


_LATIN = _latin_table()


def word_keys(text: str) -> list[bytes] | list[str]:
    """The words as Latin-1 bytes if the text fits Latin-1 (a table look-up, some 10 times faster), else as strings."""
    try:
        return text.encode("latin-1").translate(_LATIN, b"\xad").split()
    except UnicodeEncodeError:
        found = _WORD.findall(consistent(text).lower())
    try:
        return "\n".join(found).encode("latin-1").split(b"\n") if found else []
    except UnicodeEncodeError:
        return found


def words(text: str) -> list[str]:
    """Runs of letters and digits of the consistent form, lower-cased."""
    return [w.decode("latin-1") if isinstance(w, bytes) else w for w in word_keys(text)]


def _hash_forms(batches):
    import pyarrow as pa

    for batch in batches:
        ids, forms, norms = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            plain = normalize(text)
            if not plain:
                continue
            ids.append(key)
            forms.append(xxhash.xxh3_128_digest(consistent(plain).encode("utf-8", "surrogatepass")))
            norms.append(xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(forms, pa.binary()), pa.array(norms, pa.binary())], ["id", "form", "norm"])


def form_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, form, norm) of every non-empty text: hashes of its consistent and its normalised form.

    Rows with a null id or a null, empty or blank text are left out; repeated rows count once
    per row. Extra columns are ignored. One pass over the scan, no shuffle.
    """
    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null and text <> ''")
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_hash_forms, f"id {kind}, form binary, norm binary")


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", full_pairs: int = 10_000) -> DataFrame:
    """Pairs (id_a < id_b) of texts that differ after whitespace normalisation but share their consistent form.

    Every such pair is given, however many copies a text has. Texts are grouped by form, the
    members with the same normalised text are put into cells, so that two cells have about
    ``full_pairs`` pairs, and cells of different texts are paired: no pair of copies is ever made,
    and no task holds a large group at once. Empty input gives no rows.
    """
    rows = form_classes(docs, key, text)
    classes = rows.groupBy("form", "norm").agg(F.count("*").alias("n"))
    several = classes.groupBy("form").agg(F.count("*").alias("texts")).where("texts > 1").select("form")
    parts = F.ceil(F.col("n") / max(1, math.isqrt(full_pairs)))
    members = rows.distinct().join(classes.join(several, "form").select("form", "norm", parts.alias("parts")), ["form", "norm"])
    placed = members.select("form", "norm", "id", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    cells = materialize(placed.groupBy("form", "norm", "part").agg(F.collect_list("id").alias("ids")).select("form", "norm", "ids"), "forms")
    other = cells.select("form", F.col("norm").alias("norm_b"), F.col("ids").alias("ids_b"))
    pairs = cells.join(other, "form").where("norm < norm_b").select(F.explode("ids").alias("a"), "ids_b").select("a", F.explode("ids_b").alias("b"))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).where("id_a < id_b").distinct()


def _consistent_series(text: pd.Series) -> pd.Series:
    return text.map(consistent, na_action="ignore")


def consistent_col(text: Column) -> Column:
    """The consistent form as a column; null stays null."""
    return F.pandas_udf(_consistent_series, "string")(text)


def consistent_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, form_sha256, changed): every document's hash in the consistent form; null texts give nulls."""
    form = consistent_col(F.col(text))
    return docs.select(F.col(key).alias("id"), F.col(text).alias("_t"), form.alias("_f")).select("id", F.sha2("_f", 256).alias("form_sha256"), (F.col("_t") != F.col("_f")).alias("changed"))
