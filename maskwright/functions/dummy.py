"""Replacement values: of the same shape as what they replace, and always the same for the same value and key.

Draws are taken from a stream of hashes: the k-th draw is the hash of ``seed:k``. So all is one expression without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .tokens import number, seed as seed_of, sha256
from .text import is_blank, strip, words

FIRST = tuple("Alex Avery Blake Cameron Casey Drew Jamie Jordan Logan Morgan Parker Quinn Riley Ryan Sam Taylor".split())
LAST = tuple("Anderson Brown Davis Garcia Harris Jackson Johnson Jones Martin Miller Moore Smith Taylor Thomas White Wilson".split())
BODY = tuple("Alpha Atlantic Capital Central Crown Delta Global Metro National Northern Pacific Peak Premier Royal Southern Summit United".split())
TRADE = tuple("Associates Enterprises Group Holdings Industries Partners Services Solutions Systems Trading".split())
STREET = tuple("Cedar Ln,Elm St,Hill Rd,Lake Dr,Main St,Oak Ave,Park Rd,River Rd".split(","))
CITY = tuple("Bristol Clinton Franklin Georgetown Madison Salem Springfield".split())
ENDINGS = tuple(sorted("AG/A.S./A.Ş./B.V./Co/Co./& Co/& Co./Corp/Corp./Corporation/GmbH/Inc/Inc./LLC/LLP/Limited/Ltd/Ltd./N.V./PLC/Pty/S.A./S.L./Ş.T.İ.".split("/"), key=lambda x: (-len(x), x)))
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
MIXED, SMALL = UPPER + DIGITS, UPPER.lower() + DIGITS
#: Dates of birth are drawn from the ages of 18 to 80 on this day, so that they don't change from day to day.
ANCHOR = "2024-01-01"
SPACERS = " -_./:()+"


def draw(seed: Column, k: Column | int, n: int) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(number(sha256(F.concat_ws(":", seed, k if isinstance(k, Column) else F.lit(k)))), F.lit(n))


def pick(seed: Column, k: Column | int, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(seed, k, len(values)) + 1).cast("int"))


def _char(seed: Column, k: Column, chars: str) -> Column:
    return F.substring(F.lit(chars), (draw(seed, k, len(chars)) + 1).cast("int"), F.lit(1))


def _string(seed: Column, n: Column, chars: str) -> Column:
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: _char(seed, k, chars)), "")).otherwise("")


def char_class(c: Column) -> Column:
    """D digit, L letter, S spacer, X other."""
    return F.when(c.rlike(r"(?U)^\d$"), "D").when(c.rlike(r"^\p{L}$"), "L").when(F.contains(F.lit(SPACERS), c), "S").otherwise("X")


def analyze(text: Column) -> Column:
    """Runs of equal class: array of (kind, length)."""
    empty = F.expr("cast(array() as array<struct<kind: string, length: int>>)")

    def step(acc: Column, c: Column) -> Column:
        last, kind = F.get(acc, F.size(acc) - 1), char_class(c)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(kind.alias("kind"), (last["length"] + 1).alias("length"))))
        return F.when((F.size(acc) > 0) & (last["kind"] == kind), longer).otherwise(F.concat(acc, F.array(F.struct(kind.alias("kind"), F.lit(1).alias("length")))))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), empty, step)


def same_format(seed: Column, text: Column) -> Column:
    """Digits for digits, letters of the same case for letters; spacers stay."""

    def other(k: Column) -> Column:
        c = F.substring(text, k, F.lit(1))
        kind = char_class(c)
        letter = _char(seed, k, UPPER)
        out = F.when(kind == "D", _char(seed, k, DIGITS)).when(kind == "S", c)
        return out.when((kind == "L") & (c == F.lower(c)) & (c != F.upper(c)), F.lower(letter)).when(kind == "L", letter).otherwise(_char(seed, k, MIXED))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), other), "")


def name(seed: Column, text: Column) -> Column:
    n = F.size(words(text))
    parts = F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k < n, pick(seed, k, FIRST)).otherwise(pick(seed, k, LAST)))
    return F.when(n == 1, pick(seed, 1, FIRST + LAST)).otherwise(F.array_join(parts, " "))


def company(seed: Column, text: Column) -> Column:
    """With the longest known ending that the text has."""
    bare = strip(text)
    found = F.coalesce(*(F.when(F.endswith(bare, F.lit(e)), e) for e in ENDINGS), F.lit(""))
    body = strip(F.left(bare, F.length(bare) - F.length(found)))
    new = F.when(F.size(words(body)) <= 1, pick(seed, 1, BODY)).otherwise(F.concat_ws(" ", pick(seed, 1, BODY), pick(seed, 2, TRADE)))
    return F.when(found == "", new).otherwise(F.concat_ws(" ", new, found))


def email(seed: Column, text: Column) -> Column:
    domain = F.substring_index(text, "@", -1)
    local = F.length(text) - F.length(domain) - 1
    other = F.concat(_string(seed, F.greatest(local, F.lit(5)), SMALL), F.lit("@example."), F.when(F.contains(domain, F.lit(".")), F.substring_index(domain, ".", -1)).otherwise("com"))
    return F.when(F.contains(text, F.lit("@")), other).otherwise(F.concat(F.lit("user"), (draw(seed, 1, 900) + 100).cast("string"), F.lit("@example.com")))


def address(seed: Column, text: Column) -> Column:
    house = F.when(text.rlike(r"(?U)\d"), F.concat((draw(seed, 1, 999) + 1).cast("string"), F.lit(" "))).otherwise("")
    city = F.when(text.rlike(r"[,\n]"), F.concat(F.lit(", "), pick(seed, 3, CITY))).otherwise("")
    return F.concat(house, pick(seed, 2, STREET), city)


def date(seed: Column, text: Column) -> Column:
    day = F.date_sub(F.lit(ANCHOR).cast("date"), (draw(seed, 1, 62 * 365) + 18 * 366).cast("int"))
    slashes, dashes = F.contains(text, F.lit("/")), F.contains(text, F.lit("-")) & ~F.contains(text, F.lit("."))
    return F.when(slashes, F.date_format(day, "dd/MM/yyyy")).when(dashes, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yyyy"))


def reference(seed: Column, text: Column) -> Column:
    n = F.length(F.translate(text, " -", ""))
    return _string(seed, F.when(n < 6, 8).otherwise(n), MIXED)


def generic(seed: Column, text: Column) -> Column:
    n = F.length(text)
    return F.when(text.rlike(r"(?U)^\d+$"), _string(seed, n, DIGITS)).when(text.rlike(r"^\p{L}+$"), _string(seed, n, UPPER)).otherwise(_string(seed, n, MIXED))


#: How a field type is replaced; what isn't here is generic.
KINDS = {
    "name": "person_name name full_name first_name last_name signatory_name", "company": "company_name company organization", "same": "phone phone_number fax tax_id vat_number national_id id_number passport passport_number license_plate plate invoice invoice_number",
    "email": "email email_address", "address": "address street_address", "date": "date date_of_birth birth_date", "reference": "reference reference_number contract_number registration_number", "signature": "signature", "stamp": "stamp",
}
#: Pattern hits by the family of their prefix.
FAMILIES = {"same": "ssn_ nino_ insee_ cf_ dni_ plate_ phone_ postal_ ip_"}


def replacement(key: str, text: Column, field_type: Column, by_family: bool = True) -> Column:
    """The replacement of a value; blank ones and nulls stay as they are."""
    seed, kind = seed_of(key, text), F.lower(F.coalesce(field_type, F.lit("")))
    make = {"name": name(seed, text), "company": company(seed, text), "same": same_format(seed, text), "email": email(seed, text), "address": address(seed, text), "date": date(seed, text), "reference": reference(seed, text), "signature": F.lit("[SIGNATURE]"), "stamp": F.lit("[STAMP]")}
    out = F.when(is_blank(text), text)
    for how, kinds in KINDS.items():
        out = out.when(kind.isin(kinds.split()), make[how])
    if by_family:
        for how, prefixes in FAMILIES.items():
            out = out.when(kind.rlike(f"^(?:{'|'.join(prefixes.split())})"), make[how])
    return out.otherwise(generic(seed, text))
