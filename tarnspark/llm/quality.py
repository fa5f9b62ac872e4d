"""Quality rules, line first: each line is judged on its own, failing lines go, then documents that lose too much text.

Words are [^\\x20\\x09-\\x0D]+. A line without a word is blank: it goes, but nothing is lost with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

# Characters and phrases of the line rules.
SENTENCE_MARKS = ".!?…;:。！？"
NAVIGATION_MARKS = "|»›•·"
SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate lines in English, French, German and Spanish, all beginning and ending with an ASCII letter.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "log in", "sign in", "sign up", "subscribe to", "click here", "read more", "share this", "skip to content", "back to top",
    "gestion des cookies", "accepter les cookies", "mentions légales", "conditions d'utilisation", "tous droits réservés", "se connecter", "abonnez-vous", "cliquez ici", "lire la suite", "en savoir plus", "partager cet article", "haut de page",
    "cookies akzeptieren", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "alle rechte vorbehalten", "jetzt anmelden", "newsletter abonnieren", "hier klicken", "weiterlesen", "artikel teilen", "zum inhalt springen", "zum seitenanfang",
    "política de cookies", "aceptar cookies", "política de privacidad", "aviso legal", "condiciones de uso", "todos los derechos reservados", "iniciar sesión", "haz clic", "leer más", "compartir este artículo", "ir al contenido", "volver arriba",
)

#: A line is navigation if it has so many navigation marks, and one for each MARK_WORDS words at least.
MIN_MARKS, MARK_WORDS = 2, 4
#: A line fails the punctuation rule if it has no sentence mark and fewer than FRAGMENT_WORDS words (a longer one may be a line of a wrapped
#: paragraph), or one symbol for each SYMBOL_CHARS characters of its words.
SYMBOL_CHARS, FRAGMENT_WORDS = 10, 8
#: A document is rejected if failing lines hold more than LOST_PERCENT of the characters of its words.
LOST_PERCENT = 50
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

_MARK = re.compile(f"[{re.escape(SENTENCE_MARKS)}]")
_NAVIGATION = re.compile(f"[{re.escape(NAVIGATION_MARKS)}]")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_BOILERPLATE = re.compile(rf"\b(?:{'|'.join(map(re.escape, BOILERPLATE))})\b", re.ASCII)
_LOWER = {c: c + 32 for c in range(65, 91)}

VERDICT = T.StructType(
    [T.StructField(x, T.LongType(), False) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")]
    + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False), T.StructField("clean_text", T.StringType(), False)]
)


def boilerplate(line: str, n_words: int) -> bool:
    """Whether phrases, between edges of ASCII words, make up half of the line's words or more."""
    rest, found = _BOILERPLATE.subn(" ", line.translate(_LOWER))
    return found > 0 and 2 * len(rest.encode().split()) <= n_words


def line_passes(line: str, n_words: int, n_chars: int) -> bool:
    """n_chars: characters of the line's words."""
    marks = len(_NAVIGATION.findall(line))
    if marks >= MIN_MARKS and marks * MARK_WORDS >= n_words:
        return False
    if (n_words < FRAGMENT_WORDS and not _MARK.search(line)) or len(_SYMBOL.findall(line)) * SYMBOL_CHARS >= n_chars:
        return False
    return not boilerplate(line, n_words)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of WINDOW words that the text holds at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    window = code[:n]
    for k in range(1, WINDOW):  # exact: the codes of pairs are numbered anew each time
        window = np.unique(window * len(ids) + code[k : n + k], return_inverse=True)[1]
    found = np.flatnonzero(np.bincount(window)[window] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str | None) -> tuple:
    text = text or ""
    words = text.encode().split()  # bytes split at [\x20\x09-\x0D] only
    seen: set[str] = set()
    chars = lost = n_dup = 0
    kept_lines = []
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        n_chars = len(b"".join(own).decode())
        chars += n_chars
        n_dup += line in seen
        seen.add(line)
        if line_passes(line, len(own), n_chars):
            kept_lines.append(line)
        else:
            lost += n_chars
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * len(words)
    return len(words), chars, len(_SYMBOL.findall(text)), n_dup, repeat, lost, failed, not failed and 100 * lost <= LOST_PERCENT * chars, "\n".join(kept_lines)


@F.pandas_udf(VERDICT)
def _verdict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([judge(x) for x in batch], columns=VERDICT.names)


def judge_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(original struct<all input columns>, verdict struct): counts, base_failed, kept, and clean_text, the lines that pass.

    Null or empty text has no words, so it fails the base rule. Rows are judged one by one: ids may be null or repeated,
    extra columns keep their names inside `original`, and an empty table gives an empty result. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("original"), F.col(text_col).alias("text")).select("original", _verdict("text").alias("verdict"))
