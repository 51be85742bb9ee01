"""PII surrogates: keyed, type-consistent replacements that keep gender, script and format.

Every value is a string over a format (which positions hold digits, letters of a script and case, octets or names).
A keyed bijection without fixed points on the strings of that format gives the surrogate, so equal entities stay
equal, different ones stay different, and none stays itself. A corpus-wide check then finds surrogates that coincide
with each other or with a value that the corpus holds, and moves those entities on to further attempts until none is
left. Formats too full for that keep the bijection throughout: distinctness comes before avoiding values of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.store import materialize, table

KEY = b"tesserae example key"
#: Entities off their first attempt that are broadcast at most; beyond that they reach their documents by a join.
MOST_MOVED = 100_000
#: Attempts after which a format that still has clashes counts as too full, and goes back to its bijection as a whole.
ATTEMPTS = 32

#: Fixed lists: given names by script and gender.
GIVEN = {
    ("latin", "f"): ["Anna", "Carmen", "Charlotte", "Claire", "Elena", "Emily", "Emma", "Hannah", "Ingrid", "Julia", "Laura", "Lucía", "Maria", "Marie", "Mary", "Olivia", "Sarah", "Sofia", "Sophie", "Susan"],
    ("latin", "m"): ["Alexander", "Antoine", "Carlos", "Charles", "David", "Diego", "Felix", "Hans", "James", "Javier", "John", "Jürgen", "Louis", "Michael", "Pablo", "Paul", "Peter", "Robert", "Thomas", "William"],
    ("cyrillic", "f"): ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"],
    ("greek", "f"): ["Αικατερίνη", "Βασιλική", "Ελένη", "Μαρία"],
    ("greek", "m"): ["Γεώργιος", "Δημήτριος", "Ιωάννης", "Νικόλαος"],
}
#: Fixed list: titles before a name, by gender.
TITLES = {"m": ["Mr", "Sir", "Herr", "Herrn", "M", "Monsieur", "Señor", "Sr", "Don", "Господин"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "Srta", "Doña", "Госпожа"]}
#: Fixed list: words after which two capitalised words or more are a name.
CUES = frozenset("Attn Contact Cc Dear Name Regards Signed Sincerely Contacto Estimado Estimada Cher Chère Kontakt Liebe Lieber Имя".split())
#: Fixed list: words that join one name to the next.
JOINS = ("and", "or", "und", "oder", "et", "ou", "y", "o", "и", "или", "&")
#: Fixed list: endings of family names, for a woman and for a man, and last letters that mark women's names. They stay, and
#: what stands before them gets one surrogate for both.
ENDINGS = (("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын"), ("skaya", "sky"), ("ova", "ov"), ("eva", "ev"), ("dottir", "son"), ("dóttir", "son"), ("a",), ("а",), ("я",))
#: Capitalised words that end a name; none is a surname in common use.
ENDS = frozenset("And At By For From Had Has Of Said That The This Was Were When Which Who With".split())
_GIVEN = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "áàâäãåéèêëíìîïóòôöõúùûüñçßæøýÿ", "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÆØÝ"]
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_VOWELS = frozenset("aeiouyáàâäãåéèêëíìîïóòôöõúùûüæøýÿаеёиоуыэюяαεηιουω")
#: In names vowels move among vowels and consonants among consonants; signs without a sound stay.
_SOUND = {c: (part, i) for a in _ALPHABETS[1:] for vowel in (True, False) for part in ["".join(c for c in a if (c.lower() in _VOWELS) is vowel and c.lower() not in "ьъ")] for i, c in enumerate(part)}

_CAP = r"[^\W\d_a-zß-öø-ÿа-яёα-ώ]"
_NAME = rf"{_CAP}[^\W\d_]+(?:['’-]{_CAP}[^\W\d_]+)*"
_NAMES = re.compile(rf"(?<!\w){_CAP}[^\W\d_]*\.?(?: {_NAME})+(?!\w)")
_EMAIL = re.compile(r"[\w.+%-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}")
_LOCAL = re.compile(r"[\w.+%-]{1,64}\Z")
_NUMERIC = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<number>\d(?:[ -]?\d){12,18}(?![\w]|-\d))"
    r")"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key[:64], digest_size=32).digest(), "big")


def permute(value: int, size: int, key: bytes, tag: str, step: int = 1) -> int:
    """A keyed bijection of [0, size) that moves every value: conjugates adding ``step`` by an alternating Feistel network."""
    if size < 2:
        return value
    step = 1 + (step - 1) % (size - 1)
    left = 1 << (size.bit_length() // 2)
    right = -(-size // left)  # values live in [0, left * right), and walk until they are below size

    def network(x: int, back: bool) -> int:
        while True:
            a, b = x % left, x // left
            for r in reversed(range(8)) if back else range(8):
                if r % 2:
                    d = _digest(key, tag, size, r, a) % right
                    b = (b - d) % right if back else (b + d) % right
                else:
                    d = _digest(key, tag, size, r, b) % left
                    a = (a - d) % left if back else (a + d) % left
            x = b * left + a
            if x < size:
                return x

    return network((network(value, True) + step) % size, False)


def same_format(text: str, key: bytes, tag: str, step: int = 1, places: dict[str, tuple[str, int]] = _PLACE) -> str:
    """Letters move within their script and case, digits among digits, all else stays."""
    spots = [(i, *places[c]) for i, c in enumerate(text) if c in places]
    value, size = 0, 1
    for _, alphabet, place in spots:
        value, size = value * len(alphabet) + place, size * len(alphabet)
    shape = "".join(a[0] for _, a, _ in spots)
    value = permute(value, size, key, f"{tag}:{shape}", step)
    out = list(text)
    for i, alphabet, _ in reversed(spots):
        value, place = divmod(value, len(alphabet))
        out[i] = alphabet[place]
    return "".join(out)


def _luhn(digits: str) -> int:
    """Check digit for ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _name(text: str, key: bytes, step: int) -> str:
    if text in _GIVEN:
        group, i = _GIVEN[text]
        return GIVEN[group][permute(i, len(GIVEN[group]), key, f"given:{group}", step)]
    pair, end = ending(text)
    stem = text[: len(text) - len(end)]
    out = stem
    while True:  # walks on from what is another kind of name, so that names of a kind are permuted
        out = same_format(out, key, f"name:{pair}", step, _SOUND)
        if out == stem or out + end not in _GIVEN and ending(out + end) == (pair, end):
            return out + end


def ending(word: str) -> tuple[int, str]:
    """The number of the longest of ENDINGS that a name has, and its form; -1 and an empty one if there is none."""
    return max(((i, e) for i, pair in enumerate(ENDINGS) for e in pair if word.endswith(e) and len(word) > len(e) + 1), key=lambda x: (len(x[1]), -x[0]), default=(-1, ""))


def surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The replacement of an entity; ``attempt`` counts the replacements that a check turned down."""
    step = 1 + _digest(key, "attempt", attempt) % (1 << 61) if attempt else 1
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        host = same_format(".".join(labels[:-1]).lower(), key, "domain") + "." + labels[-1]
        return same_format(local, key, "local:" + domain.lower(), step) + "@" + host
    if kind == "ipv4":
        n = 0
        for part in value.split("."):
            n = n * 256 + int(part)
        n = permute(n, 1 << 32, key, "ipv4", step)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "number":
        digits = re.sub(r"\D", "", value)
        if _luhn(digits[:-1]) == int(digits[-1]):
            body = same_format(digits[:-1], key, "card", step)
            return _fill(value, body + str(_luhn(body)))
        return _fill(value, same_format(digits, key, "number", step))
    if kind == "iban":
        flat = value.replace(" ", "")
        body = same_format(flat[4:], key, "iban:" + flat[:2], step)
        check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
        it = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "phone" and value.startswith("+"):
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)[0]
        return code + same_format(value[len(code) :], key, "phone:" + code, step)
    if kind == "name":
        return _name(value, key, step)
    return same_format(value, key, kind, step)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and apart from each other.

    Names come word by word: a run of capitalised words parted by single spaces is a name from its title, its cue or else
    from its first given name to its end; a run of two words or more that an e-mail address of the text spells, or that a
    word of ``JOINS`` ties to a name before it, is one as well. A lower-case word, a mark or a word of ``ENDS`` ends it.
    """
    found, spelled = [], set()
    at = text.find("@")
    while at >= 0:
        local = _LOCAL.search(text, max(0, at - 64), at)
        m = _EMAIL.match(text, local.start()) if local else None
        if m:
            start = m.start() + len(m[0]) - len(m[0].lstrip(".%+-"))
            found.append((start, m.end(), "email"))
            parts = [x for x in re.split(r"[\W\d_]+", text[start:at].lower()) if len(x) > 1]
            spelled.update(zip(parts, parts[1:], strict=False))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    for m in _NUMERIC.finditer(text):
        found.append((m.start(), m.end(), m.lastgroup))
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if int("".join(str(int(c, 36)) for c in (m[0][4:] + m[0][:4]).replace(" ", ""))) % 97 == 1]
    known, last = set(), -1  # last: the end of the last name
    for m in _NAMES.finditer(text):
        words = [(w.start() + m.start(), w.end() + m.start(), w[0]) for w in re.finditer(r"[^ ]+", m[0])]
        plain = [w.lower() for _, _, w in words]
        before = text[max(0, m.start() - 16) : m.start()]
        cue = re.search(r"(\w+)[:,]?\s$", before)
        if words[0][2].rstrip(".") in _TITLED:
            first = 1
        elif words[0][2] in CUES and len(words) > 2:
            first = 1
        elif cue and cue[1] in CUES or 0 <= last < m.start() and text[last : m.start()].strip() in JOINS:
            first = 0
        else:
            spelt = (i for i, pair in enumerate(zip(plain, plain[1:], strict=False)) if pair in spelled or pair[::-1] in spelled)
            first = next((i for i, (_, _, w) in enumerate(words) if w in _GIVEN), next(spelt, len(words)))
        for s, e, w in words[first:]:
            if w in ENDS:
                break
            known.add(w)
            found.append((s, e, "name"))
            last = e
    if known:
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)")
        found += [(m.start(), m.end(), "name") for m in again.finditer(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for s, e, kind in found:
        if s >= end:
            out.append((s, e, kind))
            end = e
    return out


_TITLED = frozenset(t for names in TITLES.values() for t in names)
_cached = lru_cache(1 << 14)(surrogate)


def canonical(kind: str, value: str) -> str:
    """What two mentions of one entity share: e-mail addresses count without case."""
    return value.lower() if kind == "email" else value


def rewrite(text: str | None, key: bytes = KEY, moved: dict[tuple[str, str], int] | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had; null stays null."""
    spans = detect(text) if text else []
    if not spans:
        return text, 0
    out, at = [], 0
    for s, e, kind in spans:
        value = canonical(kind, text[s:e])
        out += [text[at:s], _cached(kind, value, key, (moved or {}).get((kind, value), 0))]
        at = e
    return "".join([*out, text[at:]]), len(spans)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {(k, canonical(k, x[s:e])) for x in (c.as_py() or "" for c in batch.column(0)) for s, e, k in detect(x)}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], names=["kind", "value"])


def form(kind: str, value: str) -> tuple[str, float]:
    """The format of a value and how many values it has; all surrogates of a format share one."""
    fixed, free = "", value
    if kind == "ipv4":
        return "ipv4", 2.0**32
    if kind == "email":
        free, _, fixed = value.rpartition("@")
        fixed = "@" + fixed
    elif kind == "iban":
        fixed, free = value[:2], value[4:]
    elif kind == "phone" and value.startswith("+"):
        fixed = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)[0]
        free = value[len(fixed) :]
    used = [_PLACE[c][0] if c in _PLACE else c for c in free]
    return f"{fixed}|{''.join(a[0] for a in used)}", float(math.prod(len(a) for a in used if len(a) > 1))


def _surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, tries = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, v, key, t) for k, v, t in zip(kinds, values, tries, strict=True)], pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, values, news = (batch.column(c).to_pylist() for c in ("kind", "value", "surrogate"))
        own, new = [form(k, v)[0] for k, v in zip(kinds, values, strict=True)], [form(k, v) for k, v in zip(kinds, news, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string()), pa.array([f for f, _ in new], pa.string()), pa.array([n for _, n in new], pa.float64())], names=[*batch.schema.names, "own", "form", "room"])


def moved_entities(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, value, attempt > 0) of the entities whose first surrogates clash with a value or surrogate of the corpus.

    Names draw on short lists, where a surrogate is bound to be another's name; they are distinct by construction and
    aren't moved. A format whose surrogates and corpus values don't fit in it together, or that has clashes left after
    ``ATTEMPTS`` rounds, stays at its first attempt as a whole, where all its surrogates differ; a warning counts those
    that are values of the corpus. (Numbers that pass the Luhn check and others share formats of 10^13 values and more,
    which no corpus fills.)
    """
    found = docs.select(F.col(text_col)).mapInArrow(_entities, "kind string, value string").distinct().filter("kind <> 'name'")
    row = "kind string, value string, attempt int, surrogate string"
    whole = materialize(found.withColumn("attempt", F.lit(0)).mapInArrow(_surrogates(key), row).mapInArrow(_forms, f"{row}, own string, form string, room double"))
    values = whole.select(F.col("value").alias("surrogate")).distinct()

    def clashes(now: DataFrame) -> DataFrame:
        taken = values.join(now.select("surrogate"), "surrogate", "left_semi").withColumn("hit", F.lit(True))
        twice = now.groupBy("surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("surrogate", F.col("first.value").alias("keeps"))
        return materialize(now.join(taken, "surrogate", "left").join(twice, "surrogate", "left").filter("hit or value <> keeps").select("kind", "value", "form"))

    bad = clashes(whole)
    now = whole.join(bad.select("form").distinct(), "form", "left_semi")  # surrogates of a format stay in it, so the others are done
    held = whole.groupBy(F.col("own").alias("form")).agg(F.count("*").alias("held"))
    wanted = now.groupBy("form").agg(F.count("*").alias("n"), F.first("room").alias("room"))
    full = materialize(wanted.join(held, "form", "left").filter("n + coalesce(held, 0) > room").select("form"))
    bad, now = bad.join(full, "form", "left_anti"), materialize(now.join(full, "form", "left_anti").select("kind", "value", "attempt", "surrogate", "form"))
    for attempt in range(1, ATTEMPTS + 1):
        if bad.isEmpty():
            break
        fresh = bad.select("kind", "value", F.lit(attempt).alias("attempt")).mapInArrow(_surrogates(key), row)
        fresh = fresh.join(bad, ["kind", "value"]).select(*now.columns)
        now = materialize(now.join(bad.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(fresh))
        bad = clashes(now)
    stuck = bad.select("form").distinct()
    full = materialize(full.unionByName(stuck))
    if not full.isEmpty():
        now = now.join(stuck, "form", "left_anti")
        left = whole.join(full, "form", "left_semi").join(values, "surrogate", "left_semi").count()
        warnings.warn(f"{left} surrogates are values of the corpus: their formats are too full to avoid it", stacklevel=2)
    return now.filter("attempt > 0").select("kind", "value", "attempt")


def _rewritten(key: bytes, moved, column: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            tries = batch.schema.get_field_index("_pii_moved")
            own = batch.column(tries).to_pylist() if tries >= 0 else [moved.value] * batch.num_rows
            done = [rewrite(t.as_py(), key, m if tries < 0 else {(x["kind"], x["value"]): x["attempt"] for x in m or ()}) for t, m in zip(batch.column(at), own, strict=True)]
            columns = [c for i, c in enumerate(batch.columns) if i != tries]
            names = [n for n in batch.schema.names if n != "_pii_moved"]
            columns[names.index(column)] = pa.array([t for t, _ in done], pa.string())
            if count:
                columns, names = [*columns, pa.array([n for _, n in done], pa.int64())], [*names, "n_entities"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pseudonymize(docs: DataFrame, key: bytes = KEY, text_col: str = "text", count: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and with ``count`` n_entities (a column of that name is replaced).

    Null and empty texts stay, an empty table stays empty, and repeated rows are rewritten alike. A text of any length is
    read whole. All other columns stay as they are.
    """
    plain = docs.drop("n_entities") if count else docs
    schema = T.StructType([*plain.schema.fields, *([T.StructField("n_entities", T.LongType())] if count else [])])
    moved = materialize(moved_entities(plain, key, text_col))
    if moved.count() <= MOST_MOVED:
        few = {(r["kind"], r["value"]): r["attempt"] for r in moved.toLocalIterator()}
        return plain.mapInArrow(_rewritten(key, docs.sparkSession.sparkContext.broadcast(few), text_col, count), schema)
    mentions = plain.select(F.xxhash64(text_col).alias("_pii_text"), text_col).dropDuplicates(["_pii_text"]).mapInArrow(_mentions(text_col), "_pii_text long, kind string, value string")
    held = mentions.join(moved, ["kind", "value"]).groupBy("_pii_text").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_pii_moved"))
    joined = plain.withColumn("_pii_text", F.xxhash64(text_col)).join(held, "_pii_text", "left").drop("_pii_text")
    return joined.mapInArrow(_rewritten(key, None, text_col, count), schema)


def _mentions(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h.as_py(), k, canonical(k, t[s:e])) for h, t in ((h, c.as_py() or "") for h, c in zip(batch.column(0), batch.column(1), strict=True)) for s, e, k in detect(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["_pii_text", "kind", "value"])

    return run


def op4_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates in place of personal data."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
