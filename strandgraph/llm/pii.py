"""PII surrogates: detected entities get keyed replacements of the same type.

An entity is a type and a canonical value, so one written in several formats
stays one entity. A name behind a title, and each of its words, is looked for
in the rest of its document too; names get their surrogates word by word, so
that a full name and a part of it stay the same person. Each distinct entity of the corpus gets one surrogate, made
from a keyed hash: equal entities get equal surrogates everywhere. Entities
whose surrogate meets another's, or a value that occurs in the corpus, draw
again until all differ; after some draws in the format of the value each draw
is longer than the one before, so the space of surrogates never runs out. A
surrogate is poured into the format of each place: separators, case, script,
number of digits (but for those longer draws), check digits, the ending that
marks gender, and the title before a name stay.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._scratch import Scratch, join_counted
from .line_dedup import version_of

#: Draws of one entity in the format of its value; each further draw is a character longer.
FORMAT_DRAWS = 12
#: Spans up to which they are broadcast to the documents.
BROADCAST_SPANS = 500_000
#: The setting that holds the key of the query, and the key where it is unset: surrogates of a known key can be searched for.
KEY_SETTING, DEFAULT_KEY = "spark.strandgraph.pii.key", "surrogates"

TITLES = r"Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Madame|Monsieur|Mme|Señora|Señor|Sra|Sr|г-жа|г-н|κ\."
NAME = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
#: Fixed formats; of two that start together the first wins.
PATTERNS = (
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    ("secret", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|api_?key|token))\s*[=:]\s*[\"']?(?P<value>[^\s\"',;]{6,})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)"),
    ("phone", r"(?<![\w.])\+\d{7,15}(?!\w)"),
    ("name", rf"\b(?:{TITLES})\.? (?P<value>{NAME}(?: {NAME}){{0,2}})"),
)
#: A text without any of these holds no entity. It is for Java, whose tables of
#: Unicode may be older: \p{Cn} are characters that it doesn't know yet.
HINT = rf"[@\p{{Nd}}\p{{Cn}}]|AKIA|ASIA|(?iu:password|passwd|pwd|secret|api_?key|token)|{TITLES}"


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, list[str]]:
    parts = [f"(?P<k{i}>{p.replace('?P<value>', f'?P<v{i}>')})" for i, (_, p) in enumerate(PATTERNS)]
    return re.compile("|".join(parts)), [k for k, _ in PATTERNS]


def _ascii_digits(value: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in value)


def canonical(kind: str, value: str) -> str:
    """What names the entity in every format."""
    if kind in ("card", "phone", "ssn", "iban", "ip"):
        value = _ascii_digits(value)
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value if kind == "secret" else unicodedata.normalize("NFC", value).casefold()


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """start, end, type and canonical value of each entity, from left to right."""
    pattern, kinds = _patterns()
    found = []
    for m in pattern.finditer(text or ""):
        i = int(m.lastgroup[1:]) if m.lastgroup[0] == "k" else int(m.lastgroup[1:])
        a, b = m.span(f"v{i}") if f"v{i}" in pattern.groupindex else m.span()
        if kinds[i] == "name":
            names = [w for w in re.finditer(r"\S+", text[a:b])]
            upper = [w for w in names if w.group()[0].isupper()]
            if not upper or not names[0].group()[0].isupper():
                continue
            b = a + next((names[k - 1].end() for k in range(1, len(names)) if not names[k].group()[0].isupper()), names[-1].end())
            b -= 2 * bool(re.search(r"..['’][sS]$", text[a:b]))
        found.append((a, b, kinds[i], canonical(kinds[i], text[a:b])))
    known = {w for a, b, kind, _ in found if kind == "name" for w in text[a:b].split(" ")}
    return sorted([*found, *_mentions(text, known, found)]) if known else found


def _mentions(text: str, known: set[str], found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Capitalised runs of the ``known`` words of names between the entities ``found``."""
    word = "(?:" + "|".join(re.escape(w) for w in sorted(known, key=lambda w: (-len(w), w))) + r")(?!\w)"
    run = re.compile(rf"(?<!\w)(?i:{word}(?: {word})*)")
    more, at = [], 0
    for a, b in [*[x[:2] for x in found], (len(text), len(text))]:
        for m in run.finditer(text, at, a):
            for upper, words in groupby(re.finditer(r"\S+", m.group()), lambda w: w.group()[0].isupper()):
                ends = [m.start() + x for w in words for x in w.span()]
                if upper:
                    more.append((ends[0], ends[-1], "name", canonical("name", text[ends[0] : ends[-1]])))
        at = b
    return more


class _Stream:
    """Numbers from a keyed hash of an entity and its draw."""

    def __init__(self, key: str, kind: str, value: str, draw: int) -> None:
        self.seed, self.at, self.held = f"{kind}\0{value}\0{draw}".encode(), 0, b""
        self.key = key.encode()

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.seed + self.at.to_bytes(4, "big"), hashlib.sha256).digest()
            self.at += 1
        number, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return number % n


VOWELS = frozenset("aeiouyаеёиоуыэюяαεηιουω")


@lru_cache(maxsize=4096)
def _alphabet(char: str) -> str:
    """Letters of the same script, and vowels or consonants as ``char`` is."""
    script = unicodedata.name(char, "LATIN").split()[0]
    base = {"CYRILLIC": "абвгдежзиклмнопрстуфхцчшыэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω", "LATIN": "abcdefghijklmnopqrstuvwxyz"}.get(script)
    if base:
        plain = unicodedata.normalize("NFD", char)[0]
        return "".join(c for c in base if (c in VOWELS) == (plain in VOWELS))
    page = ord(char) & ~0x1F
    near = "".join(chr(c) for c in range(page, page + 32) if unicodedata.name(chr(c), "").startswith(script) and unicodedata.category(chr(c)) == unicodedata.category(char))
    return near or char


def _letters(text: str, stream: _Stream, keep_last: bool = False, plain: bool = False) -> str:
    """Other letters and digits; ``plain`` takes cased letters from all of a-z, accented or not, vowel or not."""
    out = []
    for i, c in enumerate(text):
        ends = i + 1 == len(text) or not text[i + 1].isalpha()
        if c.isdigit():
            out.append(str(stream.below(10)))
        elif plain and (c.islower() or c.isupper()):
            pick = chr(97 + stream.below(26))
            out.append(pick.upper() if c.isupper() else pick)
        elif c.isalpha() and not (keep_last and ends):
            pool = _alphabet(c.lower())
            pick = pool[stream.below(len(pool))]
            out.append(pick.upper() if c.isupper() else pick)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def surrogate(key: str, kind: str, value: str, draw: int) -> str:
    """The canonical surrogate of a canonical value."""
    s = _Stream(key, kind, value, draw)
    longer = max(0, draw - FORMAT_DRAWS + 1)
    if kind == "ip":
        parts = []
        for part in value.split("."):
            low, high = (0, 254) if longer else (0, 9) if len(part) == 1 else (10, 99) if len(part) == 2 else (100, 254)
            parts.append(str(low + s.below(high - low + 1)))
        # more than four parts only where the addresses themselves run out
        return ".".join([*parts, *[str(s.below(255)) for _ in range(longer - FORMAT_DRAWS)]])
    if kind == "phone":
        return value[:1] + "".join(str(s.below(10)) for _ in range(len(value) - 1 + longer))
    if kind == "ssn":
        return "9" + "".join(str(s.below(10)) for _ in range(len(value) - 1 + longer))
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in range(len(value) - 2 + longer))
        last = next(str(d) for d in range(10) if _luhn(body + str(d))) if _luhn(value) else str(s.below(10))
        return body + last
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in value[4:])
        body += "".join(str(s.below(10)) for _ in range(longer))
        number = "".join(str(int(c, 36)) for c in body + value[:2])
        return f"{value[:2]}{98 - int(number + '00') % 97:02d}{body}"
    if kind == "email":
        local, host = value.rsplit("@", 1)
        local += "x" * longer
        labels = host.split(".")
        return "@".join([_letters(local, s), ".".join([*[_letters(x, s) for x in labels[:-1]], labels[-1]])])
    if kind == "secret":
        if re.fullmatch(r"(AKIA|ASIA)[0-9A-Z]{16}", value):
            return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in value[4:])
        if re.fullmatch(r"[0-9a-f]+", value):
            return "".join("0123456789abcdef"[s.below(16)] for _ in range(len(value) + longer))
        made = _letters(value + "x" * longer, s, plain=True)
        return made if any(c.isalnum() for c in value) else "".join(chr(97 + s.below(26)) for _ in made)
    return _letters(value[:-1] + "x" * longer + value[-1:], s, keep_last=True)


def pour(kind: str, canonical_surrogate: str, shown: str) -> str:
    """The surrogate in the format of the place it stands in."""
    if kind in ("card", "phone", "ssn", "iban"):
        zero = next((ord(c) - unicodedata.decimal(c) for c in shown if c.isdecimal()), 48)
        left = (chr(zero + int(c)) if c.isdecimal() else c for c in canonical_surrogate)
        return "".join([*[next(left) if c.isalnum() else c for c in shown], *left])
    if kind in ("email", "name") and len(canonical_surrogate) == len(shown):
        return "".join(n.upper() if c.isupper() else n for n, c in zip(canonical_surrogate, shown, strict=True))
    if kind == "name":
        return canonical_surrogate.upper() if shown.isupper() else canonical_surrogate.title() if shown[:1].isupper() else canonical_surrogate
    return canonical_surrogate


def _words(text: str, start: int, end: int, kind: str, value: str) -> list[tuple[int, int, str, str, int | None]]:
    """What gets a surrogate of its own: the words of a name, any other entity as it is."""
    if kind != "name":
        return [(start, end, kind, value, end)]
    words = [(start + w.start(), start + w.end()) for w in re.finditer(r"[^ ]+", text[start:end])]
    return [(a, b, kind, canonical(kind, text[a:b]), None if k else end) for k, (a, b) in enumerate(words)]


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, version, start, end (in characters), kind and value of every entity of every row.

    A name has a row for each of its words; ``whole`` is the end of the entity
    on the first of them, and null on the others.
    """
    schema = "doc_id long, version long, start int, end int, kind string, value string, whole int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *e) for i, t in enumerate(batch.column("text").to_pylist()) for x in detect(t) for e in _words(t, *x)]
            row = pa.array([e[0] for e in found], pa.int64())
            columns = [pa.array([e[k] for e in found], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.string()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("version").take(row), *columns], names=["doc_id", "version", "start", "end", "kind", "value", "whole"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version_of(F.col("text")).alias("version"), "text")
    return rows.filter(F.col("text").rlike(HINT)).mapInArrow(find, schema)


def surrogates(scratch: Scratch, found: DataFrame, key: str) -> DataFrame:
    """kind, value, uses and surrogate of every distinct entity; no two of a kind share a surrogate, none is a value of its kind."""
    values = scratch.keep(found.groupBy("kind", "value").agg(F.count("*").alias("uses")), "values")

    @F.arrow_udf("string")
    def make(kinds: pa.Array, values: pa.Array, draws: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kinds.to_pylist(), values.to_pylist(), draws.to_pylist(), strict=True)], pa.string())

    open_ = values.withColumn("draw", F.lit(0))
    settled = None
    for turn in count():
        drawn = scratch.keep(open_.withColumn("surrogate", make("kind", "value", "draw")), f"drawn{turn}")
        taken = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "surrogate", F.lit(True).alias("real"))).distinct()
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("first"))
        judged = drawn.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        good = F.col("real").isNull() & (F.col("value") == F.col("first"))
        judged = scratch.keep(judged.withColumn("good", good), f"judged{turn}")
        new = judged.filter("good").select("kind", "value", "uses", "surrogate")
        settled = new if settled is None else settled.unionByName(new)
        open_ = judged.filter("NOT good").select("kind", "value", "uses", F.lit(turn + 1).alias("draw"))
        if open_.isEmpty():
            return settled


def replace(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_entities, text with surrogates, entities.

    ``entities`` lists start, end, kind in the original text. A null text
    stays null; texts without an entity stay as they are; repeated rows are
    treated alike; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark, "pii")
    found = scratch.keep(entities(docs).distinct(), "entities")
    chosen = scratch.keep(surrogates(scratch, found, key), "surrogates")
    spans = join_counted(found, chosen, ["kind", "value"], "uses", F.concat(F.lit("\0"), F.xxhash64("doc_id", "version", "start").cast("string")))
    grouped = spans.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "surrogate", "whole"))).alias("spans"))
    grouped = scratch.keep(grouped, "spans").select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "spans")
    if found.count() <= BROADCAST_SPANS:
        grouped = F.broadcast(grouped)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version_of(F.col("text")).alias("version"), "text")
    met = rows.join(grouped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left").select("doc_id", "text", "spans")

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, list_ in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            parts, at = [], 0
            for x in list_ or []:
                parts += [text[at : x["start"]], pour(x["kind"], x["surrogate"], text[x["start"] : x["end"]])]
                at = x["end"]
            out.append("".join([*parts, text[at:]]) if list_ else text)
        return pa.array(out, pa.string())

    touched = F.coalesce(F.size("spans"), F.lit(0)) > 0
    first = F.filter("spans", lambda x: x["whole"].isNotNull())
    return met.select(
        "doc_id",
        F.greatest(F.lit(0), F.coalesce(F.size(first), F.lit(0))).cast("long").alias("n_entities"),
        F.when(touched, rewrite(F.when(touched, F.col("text")), "spans")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.transform(first, lambda x: F.struct(x["start"].alias("start"), x["whole"].alias("end"), x["kind"].alias("kind"))), F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("entities"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``replace`` of ``documents``, keyed by the setting KEY_SETTING: every row, null texts stay null."""
    return replace(spark, table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, DEFAULT_KEY))
