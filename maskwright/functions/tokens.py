"""Namespaces, keyed tokens and hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from .text import strip

#: Namespace by the first keyword that a field type contains.
KEYWORDS = tuple((k, ns) for line in "PER person name first last/ORG company organization business corp/ADR address street postal/PHN phone tel fax mobile/EML email/IDN id ssn passport license/TAX tax vat/REG registration/REF reference ref number/INV invoice/CNT contract/SIG signature sign/STP stamp seal/DAT date".split("/") for ns, *ks in [line.split()] for k in ks)
OTHER = "UNK"


def namespace(field_type: Column) -> Column:
    low = F.lower(field_type)
    out = F.when(field_type.isNull(), OTHER)
    for keyword, ns in KEYWORDS:
        out = out.when(F.contains(low, F.lit(keyword)), ns)
    return out.otherwise(OTHER)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC (RFC 2104) in hex, of two hashes, since Spark has no such function."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in raw).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def token(key: str, normalized: Column, ns: Column) -> Column:
    """``NS-`` and 8 hex digits."""
    return F.concat(ns, F.lit("-"), F.upper(F.left(hmac_sha256(key, F.concat(ns, F.lit(":"), normalized)), F.lit(8))))


def number(hexadecimal: Column) -> Column:
    """The first 32 bits of a hash in hex."""
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("bigint")


def seed(key: str, raw: Column) -> Column:
    """The number by which a value's replacement is drawn: of the raw value, but for case and outer white space."""
    return number(sha256(F.concat(F.lit(f"{key}:"), F.lower(strip(raw)))))
