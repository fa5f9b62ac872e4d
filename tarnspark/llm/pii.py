"""Personal data: regular expressions propose spans, checksums and other validators confirm them, nearby context words adjust a score.

Every kind has a score to begin with. A word of its context within NEAR characters before or after a span adds RAISE to it, a word that
tells of another number (an order, a version, an ISBN) takes LOWER from it. Base kinds (email, ip, card, phone) are reported whatever
their score once they are valid; the others only from THRESHOLD on, so that weak patterns need a word that speaks for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Characters before and after a span in which context words count, and what they change, in hundredths.
NEAR, RAISE, LOWER, THRESHOLD = 40, 30, 30, 50
#: Beginnings of lower-cased words that tell of a number of another sort.
AGAINST = ("order", "invoice", "isbn", "version", "serial", "commande", "facture", "bestell", "rechnung", "pedido", "factura")


@dataclass(frozen=True)
class Kind:
    name: str
    score: int
    context: tuple[str, ...]  # beginnings of lower-cased words


#: In the order in which spans are reported; the first four are the base.
KINDS = (
    Kind("email", 90, ("mail", "email", "contact", "write", "courriel", "correo", "schreib")),
    Kind("ip", 60, ("ip", "address", "server", "host", "adresse", "serveur", "servidor")),
    Kind("card", 70, ("card", "visa", "credit", "debit", "carte", "karte", "kredit", "tarjeta")),
    Kind("phone", 70, ("phone", "tel", "call", "mobile", "fax", "appel", "ruf", "handy", "llama")),
    Kind("iban", 90, ("iban", "bank", "account", "konto", "banque", "compte", "banco", "cuenta")),
    Kind("short_card", 35, ("card", "visa", "credit", "debit", "amex", "maestro", "carte", "karte", "kredit", "tarjeta")),
    Kind("ssn", 35, ("ssn", "social", "security", "taxpayer")),
    Kind("local_phone", 35, ("phone", "tel", "call", "mobile", "fax", "appel", "ruf", "handy", "llama")),
)
BASE = 4

LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", re.ASCII)
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
LOCAL_PHONE = re.compile(r"\b0[0-9](?:[ ./-]?[0-9]){6,11}\b", re.ASCII)
_NO_DIGIT = re.compile("[^0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_CONTEXT = {k.name: re.compile(rf"\b(?:{'|'.join(k.context)})", re.ASCII) for k in KINDS}
_AGAINST = re.compile(rf"\b(?:{'|'.join(AGAINST)})", re.ASCII)

SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("score", T.IntegerType(), False)])


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = sum(int(x) for x in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def mod_97(iban: str) -> bool:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, leave 1."""
    return int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+. A match holds one @, with what may stand before it since the match before; so each @
    is tried once, in linear time however long a run is."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of at most 255 with dots between. A longer dotted run is cut into fours from its start, as the expression's matches do."""
    for run in DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = start + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in own):
                yield start, end
            start = end + 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Proposals are cut to the country's length, at which a word must end."""
    for m in IBAN.finditer(text):
        want = IBAN_LENGTHS.get(m[0][:2])
        compact = m[0].replace(" ", "")
        if want is None or len(compact) < want:
            continue
        size = next(i for i in range(want, len(m[0]) + 1) if i - m[0].count(" ", 0, i) == want)
        if (size == len(m[0]) or m[0][size] == " ") and mod_97(compact[:want]):
            yield m.start(), m.start() + size


def find(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score in hundredths) in the order of KINDS, then start; places are code points, ends exclusive."""
    if not text:
        return []
    spans: dict[str, list[tuple[int, int]]] = {k.name: [] for k in KINDS}
    spans["email"] += emails(text)
    spans["ip"] += addresses(text)
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans["card" if len(digits) >= 16 else "short_card"].append(m.span())
    spans["phone"] += [m.span() for m in PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    base = sorted(s for k in KINDS[:BASE] for s in spans[k.name])
    spans["iban"] += _ibans(text)
    spans["ssn"] += [m.span() for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    spans["local_phone"] += [m.span() for m in LOCAL_PHONE.finditer(text)]
    out = []
    for i, kind in enumerate(KINDS):
        own = spans[kind.name] if i < BASE else _apart(spans[kind.name], base)
        for start, end in own:
            before, after = text[max(0, start - NEAR) : start].translate(_LOWER), text[end : end + NEAR].translate(_LOWER)
            near = lambda p, sides=(before, after): any(map(p.search, sides))
            score = kind.score + RAISE * near(_CONTEXT[kind.name]) - LOWER * near(_AGAINST)
            if i < BASE or score >= THRESHOLD:
                out.append((kind.name, start, end, max(0, min(100, score))))
    return out


def _apart(spans: list[tuple[int, int]], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, in order of start, that no base span meets."""
    out, ends, i, last = [], base, 0, -1
    for start, end in spans:
        while i < len(ends) and ends[i][0] < end:
            last = max(last, ends[i][1])
            i += 1
        if last <= start:
            out.append((start, end))
    return out


@F.pandas_udf(T.ArrayType(SPAN, False))
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[dict(zip(SPAN.names, s, strict=True)) for s in find(x)] for x in batch], dtype=object)


def redact(text: str | None, spans) -> str:
    """The text with <KIND> in place of each span; of overlapping spans the one that starts first, or else the longer, covers the others' start."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join(out) + (text or "")[at:]


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(original struct<all input columns>, spans array<struct<kind, start, end, score>>): spans in the order of KINDS, then start.

    Whole texts are searched; null and empty texts have no spans. Rows are searched one by one, so ids may be null or
    repeated, extra columns keep their names inside `original`, and an empty table gives an empty result. A base span is
    never dropped; another kind's span is, if it meets a base span or scores under THRESHOLD. Two spans of kinds beyond the
    base may overlap, as each is a claim of its own. The time of every expression is linear in the text. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("original"), F.col(text_col).alias("text")).select("original", _spans("text").alias("spans"))


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """find_personal_data()'s rows with redacted: the text with <KIND> in place of each span; a null text gives an empty one."""
    out = find_personal_data(docs, text_col)
    return out.withColumn("redacted", _redacted(F.col(f"original.`{text_col}`"), F.col("spans")))
