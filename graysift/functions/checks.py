"""Checks that a value is what it looks like, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _digit(text: Column, place: int) -> Column:
    """The digit at a place (from 0); 0 past the end."""
    return F.coalesce(F.substring(text, place + 1, 1).try_cast("int"), F.lit(0))


def _varied(text: Column) -> Column:
    return ~text.rlike(r"^(.)\1*$")


def valid_bsn(value: Column) -> Column:
    """Nine digits, not all equal, whose weighted sum (9 .. 2, -1) is a multiple of 11."""
    d = digits(value)
    total = reduce(lambda a, b: a + b, [_digit(d, i) * w for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1))])
    return (F.length(d) == 9) & _varied(d) & (total % 11 == 0)


def valid_luhn(value: Column) -> Column:
    """13 to 19 digits, not all equal, with a Luhn sum that is a multiple of 10."""
    d = F.reverse(digits(value))
    doubled = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    total = reduce(lambda a, b: a + b, [doubled(_digit(d, i)) if i % 2 else _digit(d, i) for i in range(19)])
    return F.length(d).between(13, 19) & _varied(d) & (total % 10 == 0)


def valid_iban(value: Column) -> Column:
    """Two letters, two digits, 10 to 30 more; the remainder by 97 is folded over the characters, so that no large
    number is ever built."""
    v = F.upper(F.regexp_replace(value, r"(?U)[\s.\-]", ""))
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        digit = c.try_cast("int")
        return F.when(digit.isNotNull(), (rest * 10 + digit) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))
    return v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (rest == 1)


def personal_email(value: Column) -> Column:
    """Not at a domain that begins like one kept for examples."""
    return ~value.rlike(r"(?i)@(?:example\.(?:com|org|net)|test\.|localhost|domein\.nl|voorbeeld\.nl)")


def outside_ip(value: Column) -> Column:
    return ~value.rlike(r"^(?:0\.|127\.|255\.255)") & (value != "1.1.1.1")


def local_endpoint(url: Column) -> Column:
    """An http(s) URL whose host is this machine, a .local name or a private IPv4 address. The host must be an
    address to count as private: a name that only begins like one does not."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    private = rf"^(?:10\.{octet}|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.{octet}\.{octet}$"
    return host.isin("localhost", "127.0.0.1", "::1", "[::1]", "0.0.0.0", "host.docker.internal") | host.endswith(".local") | host.rlike(private)


#: By type; types that are absent need no check.
CHECKS = {"bsn": valid_bsn, "iban": valid_iban, "betaalkaart": valid_luhn, "email": personal_email, "ipadres": outside_ip}
