"""Column expressions that count direct identifiers in a text; all run in the JVM.

IP addresses are tokens that match a full grammar, IPv4 or IPv6, as Python's `ipaddress` reads them.
Costly patterns run on texts that hold what every match of theirs must hold.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: What every match of a pattern holds: a postcode its last three characters, an address its dots or colons.
POSTCODE_END, IP_PART = r"\d[A-Za-z\u017F\u212A]{2}", r"[0-9]\.[0-9]|:[0-9A-Fa-f]{0,4}:"


def ipv6_pattern() -> str:
    """The grammar of IPv6 addresses: eight groups, the last two perhaps as IPv4, or fewer around one double colon."""
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{group}:){{6}}(?:{group}:{group}|{P.IPV4})"]
    for before in range(8):
        after = 7 - before
        head = f"{group}(?::{group}){{{before - 1}}}" if before else ""
        tails = [f"(?:{group}:){{0,{after - 1}}}{group}"] * (after > 0) + [f"(?:{group}:){{0,{after - 2}}}{P.IPV4}"] * (after > 1)
        forms.append(f"{head}::" + (f"(?:{'|'.join(tails)})?" if tails else ""))
    return "|".join(forms)


IPV6 = ipv6_pattern()


def email_count(c: Column) -> Column:
    return F.when(c.contains("@"), F.regexp_count(c, F.lit(P.java(P.EMAIL)))).when(c.isNotNull(), 0)


def phone_count(c: Column) -> Column:
    """Candidates that are no whole date and have nine digits or more."""
    found = F.regexp_extract_all(c, F.lit(P.java(P.PHONE)), F.lit(0))
    digits = lambda x: F.length(F.regexp_replace(x, P.java(r"\D"), ""))
    return F.size(F.filter(found, lambda x: ~F.trim(x).rlike(P.java(P.WHOLE_DATE)) & (digits(x) >= P.PHONE_DIGITS)))


def national_id_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(P.java(P.NATIONAL_ID)))


def postcode_count(c: Column) -> Column:
    return F.when(c.rlike(P.java(POSTCODE_END)), F.regexp_count(c, F.lit(P.java(P.POSTCODE)))).when(c.isNotNull(), 0)


def is_ip(token: str) -> bool:
    try:
        ipaddress.ip_address(token)
    except ValueError:
        return False
    return True


def ip_tokens(c: Column, ipv6: bool = True) -> Column:
    """The valid addresses of a text, in order."""
    tokens = F.regexp_extract_all(c, F.lit(P.java(P.IP_TOKEN)), F.lit(0))
    # tokens hold hex digits, colons and dots only, so dots are all there is to trim
    bare = F.transform(tokens, lambda x: F.trim(x, F.lit(".")))
    return F.filter(bare, lambda x: x.rlike(f"^(?:{P.IPV4}|{IPV6})$" if ipv6 else f"^{P.IPV4}$"))


def ip_count(c: Column, ipv6: bool = True) -> Column:
    return F.when(c.rlike(IP_PART), F.size(ip_tokens(c, ipv6))).when(c.isNotNull(), 0)


def entity_counts(c: Column, ipv6: bool = True) -> dict[str, Column]:
    """The five counts, independent of each other; null counts as empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    counts = (email_count(text), phone_count(text), national_id_count(text), postcode_count(text), ip_count(text, ipv6))
    return {name: n.cast("bigint") for name, n in zip(P.ENTITIES, counts, strict=True)}


def redact_preview(c: Column) -> Column:
    """Tags instead of identifiers, one kind after the other; phones here include dates and short numbers."""
    for pattern, tag in (
        (P.EMAIL, "EMAIL"),
        (P.PHONE, "PHONE"),
        (P.NATIONAL_ID, "NATIONAL_ID"),
        (P.POSTCODE, "POSTCODE"),
        (P.LOOSE_IPV4, "IP_ADDRESS"),
    ):
        c = F.regexp_replace(c, P.java(pattern), f"[{tag}]")
    return c
