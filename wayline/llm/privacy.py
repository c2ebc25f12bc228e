"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, a plus before a digit, a digit-dot-digit, two digits side by side or
with one blank or hyphen between, URL schemes, and account cues. From each anchor a local parser walks outwards and
checks what it finds. The four base kinds are, leftmost and without overlap within a kind:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+){3}, no part above 255
  card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass the Luhn test
  phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits
A match that fails its test is dropped and its characters are not tried again. Three kinds are added:
  account  an IBAN (two capitals, two digits, 11 to 30 capitals or digits, mod 97 = 1), in groups of four or solid;
           or 6 to 18 digits, blanks and hyphens allowed between, right after one of the cues in CUES and `:`, `=`, `#` or blank
  url      scheme://user[:password]@host..., with the credentials, or a mailto: or tel: address
  postal   a street address after one of PLACE_CUES: words that begin with a capital, numbers, street words and
           particles, in up to ADDRESS_PARTS parts between commas and ADDRESS_CHARS code points; the first part holds a
           street word, it or the next a house number; English, French, German and Spanish
Spans are in code points, end exclusive.

Cases: a null or empty text has no spans; texts of any length are read whole; repeated rows each give a row; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm._common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url", "postal")
CUES = (
    "iban", "account number", "account no", "acct", "passport no", "passport number", "ssn", "social security number", "tax id",
    "numéro de compte", "n° de compte", "numéro de passeport", "numéro de sécurité sociale", "numéro fiscal",
    "kontonummer", "konto-nr", "passnummer", "reisepassnummer", "sozialversicherungsnummer", "steuernummer", "steuer-id",
    "número de cuenta", "n.º de cuenta", "número de pasaporte", "pasaporte n.º", "número de la seguridad social", "número fiscal",
)
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "tel:")
PLACE_CUES = (
    "address", "adresse", "domicile", "anschrift", "dirección", "domicilio",
    "residing at", "lives at", "demeurant au", "demeurant", "habite au", "wohnhaft in", "wohnhaft", "con domicilio en", "vive en",
)
STREETS = frozenset((
    "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "court", "square", "boulevard", "blvd", "way", "terrace", "box",
    "rue", "bd", "allée", "chemin", "quai", "impasse", "cours", "place", "route", "postfach", "str",
    "calle", "c/", "avda", "av", "avenida", "paseo", "plaza", "camino", "ronda", "carrera", "apartado",
))
STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ufer", "damm")
PARTICLES = frozenset(("de", "la", "le", "les", "des", "du", "del", "los", "las", "of", "the", "der", "dem", "den", "am", "an", "im", "bis", "ter", "no", "n.º", "nº", "n°"))
#: A longer stretch, or one of more parts, is no address: such text ends where the bound is.
ADDRESS_CHARS, ADDRESS_PARTS = 160, 5
ROWS_AT_ONCE = 1000

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = frozenset("0123456789")
_LABEL = _DIGITS | frozenset(_LETTERS + _LETTERS.lower() + "-")
_LOCAL = _LABEL | frozenset("._%+")
_DIAL = _DIGITS | frozenset(" ().-")
_UPPER = _DIGITS | frozenset(_LETTERS)
_VALUES = {ord(c): str(k + 10) for k, c in enumerate(_LETTERS)}
_USER = _LOCAL | frozenset("~!$&'()*,;=:")
_STOP = frozenset(" \t\n\v\f\r\"'<>")
_ADDRESS = re.compile(r"[^\n\v\f\r;\"<>()\[\]{}|]*")
_initials = re.compile(r"[A-Z](?:\.[A-Z])*").fullmatch
_number = re.compile(r"[0-9]{1,6}[A-Za-z]?(?:[-/][0-9]{1,5}[A-Za-z]?)?").fullmatch


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    return int((iban[4:] + iban[:4]).translate(_VALUES)) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 0))
    for x in "0123456789":
        a.add_word("+" + x, ("phone", 1))
        for y in "0123456789":
            a.add_word(x + "." + y, ("ip", 2))
            for between in ("", " ", "-"):
                a.add_word(x + between + y, ("card", 1 + len(between)))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s) - 1))
    for c in CUES:
        for form in {c, c.upper(), c.title(), c.capitalize()}:
            a.add_word(form, ("cue", len(form) - 1))
    for c in PLACE_CUES:
        for form in {c, c.upper(), c.title(), c.capitalize()}:
            a.add_word(form, ("place", len(form) - 1))
    for x in _LETTERS:
        for y in _LETTERS:
            for z in "0123456789":
                a.add_word(x + y + z, ("iban", 2))
    a.make_automaton()
    return a


def _run(text: str, at: int, of: frozenset[str]) -> int:
    """The end of the run of such characters that starts at a place."""
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def _back(text: str, at: int, least: int, of: frozenset[str]) -> int:
    while at > least and text[at - 1] in of:
        at -= 1
    return at


# Each parser takes the text, the anchor's first character and the end of its kind's last match. It returns where
# the match ends (or None if nothing matches here) and the span, if it passes the test.
Parsed = tuple[int, tuple[int, int] | None] | None


def domain_end(text: str, at: int) -> int | None:
    end = _run(text, at, _LABEL)
    if end == at:
        return None
    dots = 0
    while text[end : end + 1] == "." and (to := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = to, dots + 1
    return end if dots else None


def email(text: str, at: int, least: int) -> Parsed:
    start, end = _back(text, at, least, _LOCAL), domain_end(text, at + 1)
    return None if start == at or end is None else (end, (start, end))


def ip(text: str, at: int, least: int) -> Parsed:
    start = at = _back(text, at, least, _DIGITS)
    fits = True
    for k in range(4):
        if k:
            if text[at : at + 1] != ".":
                return None
            at += 1
        end = _run(text, at, _DIGITS)
        if end == at:
            return None
        part = text[at:end].lstrip("0")
        fits = fits and (len(part) < 3 or len(part) == 3 and int(part) <= 255)
        at = end
    return at, (start, at) if fits else None


def _digit_run(text: str, at: int) -> int:
    """The end of digits with at most one blank or hyphen between each two."""
    end = _run(text, at, _DIGITS)
    while text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in _DIGITS:
        end = _run(text, end + 1, _DIGITS)
    return end


def card(text: str, at: int, least: int) -> Parsed:
    while at > least and (text[at - 1] in _DIGITS or at - 1 > least and text[at - 1] in " -" and text[at - 2] in _DIGITS):
        at -= 1 if text[at - 1] in _DIGITS else 2
    end = _digit_run(text, at)
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, (at, end) if 16 <= len(digits) <= 19 and luhn(digits) else None


def phone(text: str, at: int, least: int) -> Parsed:
    end = _back(text, _run(text, at + 2, _DIAL), at + 2, _DIAL - _DIGITS)
    if end < at + 4:  # a sign of the run has to stand between the first and the last digit
        return None
    digits = sum(c in _DIGITS for c in text[at:end])
    return end, (at, end) if 8 <= digits <= 15 else None


def iban(text: str, at: int, least: int) -> Parsed:
    if at and text[at - 1] in _LABEL:
        return None
    end, solid = at, ""
    while True:
        to = _run(text, end, _UPPER)
        solid += text[end:to]
        end = to
        if len(solid) % 4 or len(solid) > 34 or text[end : end + 1] != " " or text[end + 1 : end + 2] not in _UPPER or to == at:
            break
        end += 1
    if len(solid) > 34 and " " not in text[at:end]:
        return None
    while end > at:  # a following capitalised word may have been taken for a group
        solid = text[at:end].replace(" ", "")
        if 15 <= len(solid) <= 34 and solid[2:4].isdigit() and mod97(solid) and text[end : end + 1] not in _LABEL:
            return end, (at, end)
        cut = text.rfind(" ", at, end)
        if cut < 0:
            return None
        end = cut
    return None


def cued(text: str, at: int, least: int, cue_end: int) -> Parsed:
    if at and text[at - 1] in _LABEL:
        return None
    start = _run(text, cue_end, frozenset(" :=#.\t"))
    if start == cue_end or start - cue_end > 4:
        return None
    end = _digit_run(text, start)
    digits = sum(c in _DIGITS for c in text[start:end])
    return (end, (start, end)) if start >= least and 6 <= digits <= 18 and text[end : end + 1] not in _LABEL else None


def url(text: str, at: int, least: int, scheme_end: int, user: list[int | None]) -> Parsed:
    """user: where the last user that was looked for begins and ends, and the end of the domain after it, for the schemes within it."""
    if at < least or at and text[at - 1] in _LABEL:
        return None
    scheme = text[at:scheme_end]
    if scheme == "tel:":
        end = _back(text, _run(text, scheme_end, _DIAL | {"+"}), scheme_end, _DIAL - _DIGITS)
        return (end, (at, end)) if 6 <= sum(c in _DIGITS for c in text[scheme_end:end]) <= 15 else None
    if not user[0] <= scheme_end < user[1]:
        to = _run(text, scheme_end, _USER)
        user[:] = scheme_end, to, domain_end(text, to + 1) if text[to : to + 1] == "@" else None
    _, to, end = user
    if to == scheme_end or end is None:
        return None
    if scheme != "mailto:":
        while end < len(text) and text[end] not in _STOP:
            end += 1
        end = _back(text, end, to + 1, frozenset(".,;:!?)"))
    return end, (at, end)


def _is_street(word: str) -> bool:
    word = word.lower().rstrip(".")
    return word in STREETS or word.endswith(STREET_ENDS)


def _address_words(text: str, at: int, end: int) -> tuple[list[str], int, bool]:
    """The words between two commas that an address may hold, up to the first other one, where they end, and whether
    that is the comma. Particles at the end are left out; a full stop ends the words, but after a short street word or initials."""
    words, to = [], at
    for m in re.compile(r"[^ \t]+").finditer(text, at, end):
        bare = m[0].rstrip(".:!?")
        if not bare or not (bare[0].isupper() or _number(bare) or _is_street(bare) or bare.lower() in PARTICLES or bare[:2].lower() in ("d'", "l'", "d’", "l’")):
            break
        words.append(bare)
        short = m[0] == bare + "." and (len(bare) < 5 and _is_street(bare) or _initials(bare)) or m[0].lower().endswith("str.")
        to = m.end() if short else m.start() + len(bare)
        if to < m.end():
            break
    else:
        return words, to, bool(words)
    while words and words[-1].lower() in PARTICLES:
        to = len(text[at:to].rstrip()[: -len(words.pop())].rstrip()) + at
    return words, to, False


def postal(text: str, at: int, least: int, cue_end: int) -> Parsed:
    if at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        return None
    start = _run(text, cue_end, frozenset(" :=\t"))
    if start == cue_end or start - cue_end > 4 or start < least or text[start : start + 4].lower() == "the ":
        return None
    stop, to, street, number = _ADDRESS.match(text, start, min(len(text), start + ADDRESS_CHARS)).end(), start, False, False
    for k in range(ADDRESS_PARTS):
        comma = text.find(",", to if not k else to + 1, stop)
        words, end, whole = _address_words(text, to if not k else to + 1, comma if comma >= 0 else stop)
        street = street or not k and any(map(_is_street, words))
        number = number or k < 2 and any(map(_number, words))
        if not words or not street or k and not number:
            break
        to = end
        if not whole or comma < 0:
            break
        to = comma
    if text[to - 1 : to] == "," or text[to : to + 1] == ",":
        to = len(text[start:to].rstrip(", \t")) + start
    return (to, (start, to)) if street and number else None


PARSERS = {"email": email, "ip": ip, "card": card, "phone": phone}
_anchors: list[ahocorasick.Automaton] = []


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind in the order of KINDS, then start."""
    if not _anchors:
        _anchors.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    user: list[int | None] = [0, 0, None]
    for last, (kind, back) in _anchors[0].iter(text):
        at = last - back
        out = {"cue": "account", "iban": "account", "place": "postal"}.get(kind, kind)
        if at < past[out] and kind != "ip":
            continue
        if kind == "ip" and at < past[out] and _run(text, at, _DIGITS) <= past[out]:
            continue
        if kind in PARSERS:
            got = PARSERS[kind](text, at, past[out])
        elif kind == "iban":
            got = iban(text, at, past[out])
        elif kind == "cue":
            got = cued(text, at, past[out], last + 1)
        elif kind == "place":
            got = postal(text, at, past[out], last + 1)
        else:
            got = url(text, at, past[out], last + 1, user)
        if got:
            past[out] = got[0]
            if got[1]:
                found[out].append(got[1])
    return [(k, *span) for k in KINDS for span in sorted(found[k])]


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and spans: array of (kind, start, end, text), by kind in the order of KINDS, then start."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                spans = [[{"kind": k, "start": s, "end": e, "text": t[s:e]} for k, s, e in find_spans(t)] for t in (x or "" for x in rows.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, pa.list_(span))], names=[id, "spans"])

    schema = T.StructType([docs.schema[id], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])))])
    return docs.select(id, text).mapInArrow(run, schema)


def redact(text: str) -> str:
    """The text with each span, the longer of two that overlap, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
