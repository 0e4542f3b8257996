"""The form of a value by which its occurrences are recognised."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .text import squeeze, strip

#: Labels that scanned forms put before a value, taken off one after the other.
LABELS = (r"T\.?C\.?\s*KIMLIK\s*NO\.?", r"KIMLIK\s*NO\.?", "ADI?", "SOYADI?", r"ADI?\s*SOYADI?", r"V\.?K\.?N\.?", "PLAKA", r"TEL\.?", "GSM", "E-?POSTA", "ADRES")
_IDS = ("ssn", "nino", "insee", "national_id", "tax_id", "id_number")
_FOLD_FROM, _FOLD_TO = "ığüşöç#_", "igusoc"


def without_label(text: Column) -> Column:
    """A value without its label; the text as it was if nothing else is left."""
    rest = strip(text)
    for label in LABELS:
        rest = F.regexp_replace(rest, rf"(?iU)^{label}\s*:?\s*", "")
    rest = strip(rest)
    return F.when(rest == "", text).otherwise(rest)


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. Only texts beyond ASCII go to a Python worker."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfkc(F.when(odd, text)), text)


def normalize(text: Column, field_type: Column, unicode: bool = True) -> Column:
    """'' for null; ``unicode=False`` leaves NFKC out, for text known to be ASCII."""
    kind = F.lower(F.coalesce(field_type, F.lit("")))
    has = lambda *xs: F.coalesce(*(F.when(F.contains(kind, F.lit(x)), True) for x in xs), F.lit(False))
    value = without_label(F.coalesce(text, F.lit("")))
    value = nfkc(value) if unicode else value
    compact = F.upper(F.regexp_replace(value, r"(?U)[\s\-]+", ""))
    digits = F.regexp_replace(value, r"(?U)[^\d+]", "")
    ids = F.upper(F.regexp_replace(value, r"(?U)[\s.\-]", ""))
    low = F.translate(squeeze(F.lower(value)), _FOLD_FROM, _FOLD_TO)
    letters = F.when(F.replace(low, F.lit(" "), F.lit("")).rlike(r"(?U)^\d+$"), low).otherwise(F.translate(low, "01|!", "olll"))
    plain = strip(F.regexp_replace(letters, r"""[.,;:!?'"-]""", ""))
    out = F.when(has("plate", "license"), strip(compact)).when(has("phone", "tel", "fax"), digits).when(has("email"), strip(F.lower(value)))
    return out.when(has(*_IDS), ids).otherwise(plain)
