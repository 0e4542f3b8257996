"""What is looked for: identifier formats, company endings, and what is known about each kind."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from .text import has_outer_space, strip_if_any


class Pattern(NamedTuple):
    name: str
    form: str
    regulations: tuple[str, ...]
    risk: str
    #: 'email', 'id' or '' as far as confidence goes.
    trust: str = ""
    whole: bool = True  # between word boundaries


#: In forms, # is a digit, L a letter and _ optional white space; the rest is a regular expression.
_FORMS = """
email      gdpr,kvkk,ccpa,lgpd MEDIUM   email
ip_address gdpr,kvkk,ccpa      MEDIUM   -     part #{1,3}(?:\\.#{1,3}){3}
ssn_us     ccpa,hipaa          CRITICAL id    word #{3}-#{2}-#{4}
nino_uk    gdpr                CRITICAL id    word L{2}(?:_##){3}_L
insee_fr   gdpr                CRITICAL id    word (?:1|2)(?:_##){3}(?:_###){2}_##
cf_it      gdpr                CRITICAL id    word L{6}##L##L###L
dni_es     gdpr                CRITICAL id    word (?:#{8}|[X-Z]#{7})L
plate_tr   kvkk,gdpr           HIGH     -     word ##_L{1,3}_#{2,4}
plate_uk   gdpr                HIGH     -     word LL##_LLL
plate_fr   gdpr                HIGH     -     word LL-###-LL
plate_it   gdpr                HIGH     -     word LL_###_LL
plate_es   gdpr                HIGH     -     word ####_LLL
plate_ru   gdpr                HIGH     -     word L###LL_#{2,3}
postal_uk  gdpr                LOW      -     word L{1,2}#{1,2}L?_#LL
phone_us   ccpa                MEDIUM   -     part [+]1_[(]?###[)]?_###_####
phone_tr   kvkk,gdpr           MEDIUM   -     part [+]90(?:_###){2}(?:_##){2}
phone_de   gdpr                MEDIUM   -     part [+]49_#{3,4}_#{6,8}
phone_fr   gdpr                MEDIUM   -     part [+]33_#(?:_##){4}
phone_uk   gdpr                MEDIUM   -     part [+]44_#{4}_#{6}
phone_ru   gdpr                MEDIUM   -     part [+]7(?:_###){2}(?:_##){2}
"""


def _patterns() -> list[Pattern]:
    out = []
    for line in _FORMS.strip().splitlines():
        name, regs, risk, trust, *rest = line.split(None, 5)
        form = rest[1] if rest else ""
        out.append(Pattern(name, form, tuple(regs.upper().split(",")), risk, trust.strip("-"), bool(rest) and rest[0] == "word"))
    return out


#: In the order in which hits of a block are numbered. Dates are found by none: they never count as personal.
PATTERNS = _patterns()
_LOCAL = r"[A-Z0-9._%+-]"


def java(p: Pattern) -> str:
    """Unicode classes and case as in Python. A match of the email pattern begins where a run of its characters does, which keeps long texts linear."""
    if p.trust == "email":
        return rf"(?iU)(?<!{_LOCAL}){_LOCAL}++@[A-Z0-9.-]+\.[A-Z]{{2,}}"
    body = p.form.replace("#", r"\d")
    body = body.replace("_", r"\s*").replace("L", "[A-Zİ]")
    return "(?iU)" + (rf"\b(?:{body})\b" if p.whole else body)


def first_hit(text: Column, p: Pattern) -> Column:
    """The first match in the text, '' if there is none. All but emails need a digit, which a cheap test asks for first."""
    ask = F.contains(text, F.lit("@")) if p.trust == "email" else text.rlike(r"(?U)\d")
    return F.when(ask, F.regexp_extract(text, java(p), 0)).otherwise("")


def confidence(block: Column, p: Pattern) -> Column:
    if p.trust:
        return F.lit(0.90 if p.trust == "email" else 0.88)
    return F.least(block * F.lit(0.7), F.lit(0.75))


_PLAIN = "LTD LIMITED INC INCORPORATED CORP CORPORATION COMPANY LLC LLP PLC AS AŞ ŞTİ HOLDİNG HOLDING GMBH OHG SARL SAS EURL SRL SPA WLL FZE FZC JSC"
_STOP = "LTD INC CORP ŞTİ"
_DOTTED = "LLC LLP PLC AS AŞ GMBH OHG SARL SAS EURL SRL SPA WLL FZE FZC JSC"
#: Company endings that count; shorter ones (CO, AG, SA and the like) would be found everywhere.
SUFFIXES = sorted({*_PLAIN.split(), *(f"{x}." for x in _STOP.split()), *("".join(f"{c}." for c in x) for x in _DOTTED.split()), "LTD.ŞTİ.", "LTD. ŞTİ.", "GMBH & CO. KG"}, key=lambda x: (-len(x), x))
SENTENCE = tuple(sorted("you the for and can will with this that".split()))


def either(values) -> str:
    return "|".join(re.sub(r"([.&])", r"[\1]", v) for v in values)


def has_company_suffix(text: Column) -> Column:
    """Whether a short text that isn't a sentence ends in, or has a capitalised run before, a company ending."""
    low = F.lower(text)
    common = sum((F.contains(low, F.lit(f" {w} ")).cast("int") for w in SENTENCE), F.lit(0))
    last = either(SUFFIXES)

    def named(up: Column) -> Column:
        # What an ending needs in any case is asked before the expressions that try each start.
        ends = reduce(or_, (F.endswith(up, F.lit(s)) for s in SUFFIXES)) & up.rlike(rf"(?sU)^.+\S\s*(?:{last})\z")
        after = rf"\s(?:{last})(?:[.,\s]|\z)"
        return (F.length(up) <= 100) & (ends | (up.rlike(f"(?U){after}") & up.rlike(rf"(?U)\b[A-Z][A-Z0-9&\s]+{after}")))

    # Capitals are never fewer than the letters, so a longer text is out unless white space is taken off it. They are made once, for a function of them.
    short = (F.length(text) <= 100) | has_outer_space(text)
    return short & F.get(F.transform(F.array(strip_if_any(F.upper(text))), named), F.lit(0)) & (common < 2)


#: What must not be left in masked text; all matches count.
LEAKS = {"email": rf"(?iU)(?<!{_LOCAL}){_LOCAL}++@[A-Z0-9.-]+\.[A-Z]{{2,}}", "ssn": r"(?U)\d{3}-\d\d-\d{4}", "phone": r"(?U)\+?[1-9]\d{6,14}"}
#: Marks of text that has been masked.
MASKED = r"[A-Z]{3}-[0-9A-F]{8}|\[(?:MASK|REDACT)ED\]|X{4}|\*{4}"
GENERIC = tuple(sorted("date,page,total,amount,quantity,description,price,tax,subtotal,terms and conditions,please,thank you,sincerely,regards,dear,reference".split(",")))
BOILERPLATE = "|".join(sorted("all rights reserved,confidential,for official use only,please review,subject to,terms and conditions".split(",")))
