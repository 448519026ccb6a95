"""Surrogates for personal data and secrets.

Detected entities get replacements drawn from a keyed digest of the entity, so the same entity reads the same in every document. A replacement
keeps type, format, script and, for names after a title, gender; card and account numbers stay valid. All entities of the corpus are
compared: a replacement that another entity already has, or that is itself a real entity, is drawn again, so different entities stay
different and nobody else's data turns up. Characters of any script are replaced within it; where a form leaves too little room, it gets
longer after some vain draws, so draws come to an end. An e-mail's domain is an entity of its own. A name that stands behind a title
once is replaced in the whole text. Texts without a character that an entity needs skip all joins.

Defined cases: a null text stays null; entities within a longer one aren't replaced apart; digits that fail a card's or an account's check sum,
and addresses with a part above 255, are no entities; rows with the same id are documents of their own; an empty table gives no rows;
input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm.common import lookup_join, read, written

#: A deployment passes its own secret key; this one only makes test runs agree.
KEY = b"a key of the deployment"
_TITLES = {
    "male": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"),
}
_GENDER = {t: g for g, titles in _TITLES.items() for t in titles}
ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?<![.\-]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?=[A-Za-z0-9]{0,39}\d)(?=[A-Za-z0-9]{0,39}[A-Z])[A-Za-z0-9]{40})(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{8,14}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?<!\w)(?P<title>" + "|".join(_GENDER) + r")\.? (?P<name>[^\W\d_a-zа-я][^\W\d_]+(?: [^\W\d_a-zа-я][^\W\d_]+)?)"
)
_UPPER_HEX = re.compile("[0-9A-F]+")
#: After so many vain draws, and again after as many more, a surrogate gets longer: forms too short or too plain to differ find room that way.
WIDEN = 6
_SYLLABLES = {"latin": "ba ce di fo gu la me ni ro su ta ve".split(), "cyrillic": "ба ве ди го лу ма не ри со та".split(), "greek": "βα γε δι κο λυ μα νε ρι σο τα".split()}
_ENDS = {("latin", "female"): "a", ("latin", "male"): "on", ("cyrillic", "female"): "а", ("cyrillic", "male"): "ов", ("greek", "female"): "α", ("greek", "male"): "ος", ("latin", "family"): "er", ("greek", "family"): "ου"}


def luhn(digits: str) -> int:
    """The digit that completes a card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _iban_rest(number: str) -> int:
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def _valid(kind: str, surface: str) -> bool:
    if kind == "ip":
        return all(int(x) <= 255 for x in surface.split("."))
    if kind == "card":
        digits = re.sub(r"\D", "", surface)
        return luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1
    if kind == "iban":
        return _iban_rest(surface.replace(" ", "")) == 1
    return True


def _detected(text: str) -> Iterator[tuple[str, str, int, int]]:
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        if kind == "name":
            # each word of a name is an entity, so a family name alone still refers to the same family; it has a gender in Cyrillic only
            for word in re.finditer(r"[^ ]+", m["name"]):
                canonical = word.group().casefold()
                family = word.end() == len(m["name"]) and not "а" <= canonical[0] <= "я"
                yield f"name/{'family' if family else _GENDER[m['title']]}", canonical, m.start("name") + word.start(), m.start("name") + word.end()
        elif _valid(kind, m.group()):
            surface = m.group()
            canonical = {"email": str.lower, "secret": lambda s: s.lower() if _UPPER_HEX.fullmatch(s) else s, "ip": lambda s: ".".join(str(int(x)) for x in s.split("."))}.get(kind, lambda s: re.sub(r"[ ().-]", "", s))(surface)
            yield kind, canonical, m.start(), m.end()


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """Type, canonical form, start and end (in code points) of each entity, in order. The words of a name that stands behind a title are
    entities wherever they stand in the text, as the person that was named first so."""
    found = list(_detected(text))
    names: dict[str, tuple[str, str]] = {}
    for kind, canonical, start, end in found:
        if kind.startswith("name/"):
            names.setdefault(text[start:end], (kind, canonical))
    if names:
        taken = {start for _, _, start, _ in found}
        inside = [(start, end) for kind, _, start, end in found if not kind.startswith("name/")]
        words = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        for m in words.finditer(text):
            if m.start() not in taken and not any(a < m.end() and m.start() < b for a, b in inside):
                found.append((*names[m.group()], m.start(), m.end()))
        found.sort(key=lambda e: e[2])
    return found


def may_hold(text: Column) -> Column:
    """False only for texts without any entity."""
    titled = [text.contains(f"{t}{end}") for t in _GENDER for end in (" ", ". ")]
    return F.coalesce(text.rlike("[@0-9]") | text.rlike("[a-f]{32}|[A-F]{32}") | reduce(or_, titled), F.lit(False))


def _draws(key: bytes, kind: str, canonical: str, attempt: int) -> Callable[[int], int]:
    state = {"n": 0, "pool": b""}

    def draw(below: int) -> int:
        if len(state["pool"]) < 4:
            state["pool"] = hmac.new(key, f"{kind}|{canonical}|{attempt}|{state['n']}".encode(), hashlib.sha256).digest()
            state["n"] += 1
        value, state["pool"] = state["pool"][:4], state["pool"][4:]
        return int.from_bytes(value, "big") % below

    return draw


@cache
def _kin(c: str) -> str:
    """The characters that may stand for one: digits for a digit, letters of its script for a letter, itself for any other."""
    for first, last in ("09", "az", "AZ", "ая", "АЯ", "αω", "ΑΩ"):
        if first <= c <= last:
            return "".join(map(chr, range(ord(first), ord(last) + 1)))
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(chr(zero + i) for i in range(10))
    if kind[0] != "L":
        return c
    # a block of 256 code points doesn't mix living scripts of one category; lower case stays lower case
    block = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == kind and unicodedata.normalize("NFKC", x.casefold()) == x) or c


def _like(c: str, draw: Callable[[int], int], hexadecimal: bool = False) -> str:
    """A character of the same kind and script."""
    kin = "0123456789abcdef" if hexadecimal and c in "0123456789abcdef" else _kin(c)
    return kin[draw(len(kin))]


def surrogate(kind: str, canonical: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical form that stands in for an entity. An e-mail's keeps the domain, which is an entity of its own."""
    draw = _draws(key, kind, canonical, attempt)
    longer = attempt // WIDEN
    if kind == "email":
        local, _, domain = canonical.partition("@")
        return "".join(_like(c, draw) for c in local) + "".join(_like("a", draw) for _ in range(longer)) + "@" + domain
    if kind == "domain":
        # the last label is kept; all addresses of a domain move to one domain
        *labels, last = canonical.split(".")
        labels[0] += "a" * longer
        return ".".join(["".join(_like(c, draw) for c in x) for x in labels] + [last])
    if kind == "ip":
        return ".".join(str(1 + draw(254)) for _ in range(4 + longer))
    if kind == "card":
        digits = canonical[0] + "".join(_like(c, draw) for c in canonical[1:-1] + "0" * longer)
        return digits + _kin(canonical[-1])[luhn(digits)]
    if kind == "iban":
        body = "".join(_like(c, draw) for c in canonical[4:] + "0" * longer)
        return canonical[:2] + f"{98 - _iban_rest(canonical[:2] + '00' + body):02d}" + body
    if kind == "phone":
        kept = 2 if canonical.startswith("+") else 0
        return canonical[:kept] + "".join(_like(c, draw) for c in canonical[kept:] + "0" * longer)
    if kind == "secret":
        return "".join(_like(c, draw, all(x in "0123456789abcdef" for x in canonical)) for c in canonical + "a" * longer)
    if kind.startswith("name/"):
        script = "cyrillic" if "а" <= canonical[0] <= "я" else "greek" if "α" <= canonical[0] <= "ω" else "latin"
        parts = _SYLLABLES[script]
        return "".join(parts[draw(len(parts))] for _ in range(3 + attempt // 4)) + _ENDS[script, kind[5:]]
    return "".join(_like(c, draw) for c in canonical + "0" * longer)


def dressed(kind: str, surface: str, replacement: str) -> str:
    """The replacement in the format of the place where the entity stands: separators and capitals."""
    if kind in ("email", "ip", "secret"):
        return replacement.upper() if surface.isupper() and kind != "ip" else replacement
    if kind.startswith("name/"):
        return replacement.upper() if surface.isupper() and len(surface) > 1 else replacement.capitalize()
    fresh = iter(replacement)
    return "".join([c if c in " ().-" else next(fresh) for c in surface]) + "".join(fresh)


def named(text: str) -> Iterator[tuple[str, str]]:
    """Type and canonical form of all that needs a replacement: the entities, and the domains of e-mails."""
    for kind, canonical, _, _ in entities(text):
        yield kind, canonical
        if kind == "email":
            yield "domain", canonical.partition("@")[2]


def replaced(text: str, table: dict[tuple[str, str], str]) -> tuple[str, list[dict]]:
    """The text with its entities' replacements, and where they stood."""
    parts, spans, at = [], [], 0
    for kind, canonical, start, end in entities(text) if table else ():
        made = table[kind, canonical]
        if kind == "email":
            made = made.partition("@")[0] + "@" + table["domain", canonical.partition("@")[2]]
        made = dressed(kind, text[start:end], made)
        parts += [text[at:start], made]
        spans.append({"kind": kind, "start": start, "end": end, "replacement": made})
        at = end
    return "".join([*parts, text[at:]]), spans


def _found(docs: DataFrame) -> DataFrame:
    """``row``, ``kind`` and ``canonical`` of the entities of each text, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row, kind, canonical) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for kind, canonical in dict.fromkeys(named(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[i] for x in out], pa.string()) for i in (1, 2))], ["row", "kind", "canonical"])

    return docs.select("row", "text").mapInArrow(run, "row long, kind string, canonical string")


def replacements(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind``, ``canonical``, ``n`` and ``replacement`` of every distinct entity. Entities that draw a replacement which is taken or real draw
    again, until none is left; the least entity keeps what several have drawn."""

    def drawn(attempt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [surrogate(k, c, attempt, key) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "canonical", "n", "replacement"])

        return run

    real = written(found.groupBy("kind", "canonical").agg(F.count(F.lit(1)).alias("n")), "entities")
    schema = "kind string, canonical string, n long, replacement string"
    open_, settled, attempt = real, None, 0
    while True:
        offer = written(open_.mapInArrow(drawn(attempt), schema), "offers")
        first = offer.groupBy("kind", "replacement").agg(F.min("canonical").alias("canonical"))
        taken = real.select("kind", F.col("canonical").alias("replacement"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "replacement"))
        good = first.join(taken, ["kind", "replacement"], "left_anti")
        won = written(offer.join(good, ["kind", "replacement", "canonical"], "left_semi").select(*offer.columns), "settled")
        settled = won if settled is None else settled.union(won)
        open_ = written(open_.join(won, ["kind", "canonical"], "left_anti"), "open")
        attempt += 1
        if open_.isEmpty():
            return settled


def replace_entities(docs: DataFrame, text_column: str = "text", key: bytes = KEY) -> DataFrame:
    """The documents with ``clean_text`` and ``entities`` (type, start and end in the text, replacement)."""
    new = {"clean_text", "entities"}
    plain = [f"column_{i}" for i in range(len(docs.columns))]
    names = dict(zip(plain, docs.columns, strict=True))
    frame = docs.toDF(*plain)
    text = F.col(plain[docs.columns.index(text_column)])
    kept = [c for c in plain if names[c].lower() not in new]
    may = may_hold(text)
    marks = "array<struct<kind:string,start:int,end:int,replacement:string>>"
    # a number for each row of the few texts that may hold an entity, in a written table
    few = written(frame.filter(may).select(*kept, text.alias("text")).withColumn("row", F.monotonically_increasing_id()), "candidates")
    found = written(_found(few), "found")
    mapped = lookup_join(found, replacements(found, key), ["kind", "canonical"], "n")
    of_row = mapped.groupBy("row").agg(F.collect_list(F.struct("kind", "canonical", "replacement")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text, known in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                text, spans = replaced(text, {(k["kind"], k["canonical"]): k["replacement"] for k in known or ()})
                texts.append(text)
                found.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(found, kind)], [*kept, "clean_text", "entities"])

    source = few.join(of_row, "row", "left").select(*kept, "text", "known")
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField("clean_text", T.StringType()), T.StructField("entities", T._parse_datatype_string(marks))])
    rest = frame.filter(~may).select(*kept, text.alias("clean_text"), F.array().cast(marks).alias("entities"))
    return source.mapInArrow(run, schema).unionByName(rest).toDF(*[names[c] for c in kept], "clean_text", "entities")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.col("clean_text").alias("text"), "entities")


QUERIES = {"op7_pii_surrogates": op7_pii_surrogates}
ORACLE: dict[str, str] = {}
