"""Checksums and format checks of identifiers, as Column expressions that stay in the JVM.

Each takes a string Column.  ``*_valid`` functions are true, false, or null for null; ``*_status`` functions give valid,
invalid, unknown, or null where the value hasn't the format at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that separate groups of an identifier.
SEPARATORS = " \t\r\n  .\\-/‐‑–"
# IBAN length and account grammar by country.
IBAN_SPECS = {
    "AT": (20, "[0-9]{16}"),
    "BE": (16, "[0-9]{12}"),
    "CH": (21, "[0-9]{5}[A-Z0-9]{12}"),
    "DE": (22, "[0-9]{18}"),
    "ES": (24, "[0-9]{20}"),
    "FR": (27, "[0-9]{10}[A-Z0-9]{11}[0-9]{2}"),
    "GB": (22, "[A-Z]{4}[0-9]{14}"),
    "IE": (22, "[A-Z]{4}[0-9]{14}"),
    "IT": (27, "[A-Z][0-9]{10}[A-Z0-9]{12}"),
    "LU": (20, "[0-9]{3}[A-Z0-9]{13}"),
    "NL": (18, "[A-Z]{4}[0-9]{10}"),
    "PL": (28, "[0-9]{24}"),
    "PT": (25, "[0-9]{21}"),
}
# Check letters of the Spanish identifier.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
# Printed form and odd-place values of the Italian fiscal code.
FISCAL = "[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]"
#: Values of the characters 0-9, then A-Z, at odd places of an Italian tax code.
FISCAL_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
# Prefixes that are never given out.
NINO_REFUSED = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
_DIGITS_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})\\z")


def _digit(value: Column, place: int) -> Column:
    """The digit at a place from 1 on, as a number."""
    return F.substring(value, place, 1).cast("int")


def _chars(value: Column) -> Column:
    """Its characters; an empty value has none."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def _rank(char: Column) -> Column:
    """0-35 for 0-9 and A-Z."""
    return F.when(char.rlike("^[0-9]"), F.ascii(char) - 48).otherwise(F.ascii(char) - 55)


def compact(value: Column) -> Column:
    """Upper case without separators."""
    return F.upper(F.regexp_replace(value, f"[{SEPARATORS}]+", ""))


def mod97(value: Column) -> Column:
    """Remainder by 97 of the number that digits and letters (A = 10) spell out."""
    return F.aggregate(_chars(value), F.lit(0), lambda r, c: F.when(c.rlike("^[0-9]"), (r * 10 + _rank(c)) % 97).otherwise((r * 100 + _rank(c)) % 97))


def _turned(value: Column) -> Column:
    return F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))


def iban_valid(value: Column) -> Column:
    """15-34 letters and digits, any country, remainder 1; blanks are ignored."""
    core = F.replace(value, F.lit(" "), F.lit(""))
    return _full(core, "[A-Z0-9]{15,34}") & (mod97(_turned(core)) == 1)


def iban_status(value: Column) -> Column:
    core = compact(value)
    known = reduce(lambda out, kv: out.when(F.substring(core, 1, 2) == kv[0], F.when((F.length(core) == kv[1][0]) & _full(F.substring(core, 5, 64), kv[1][1]) & (mod97(_turned(core)) == 1), "valid").otherwise("invalid")), IBAN_SPECS.items(), F.when(~_full(core, "[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}"), "invalid"))
    return known.otherwise("unknown")


def luhn_valid(digits: Column) -> Column:
    """Every second digit from the right is doubled, nines cast out, and the sum ends in 0."""
    total = F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return _full(digits, "[0-9]+") & (total % 10 == 0)


def dni_status(core: Column) -> Column:
    """Spanish DNI or NIE: eight digits (or X, Y, Z and seven) and a letter by remainder 23."""
    lead = F.translate(F.substring(core, 1, 1), "XYZ", "012")
    number = F.concat(lead, F.substring(core, 2, 7)).cast("int")
    letter = F.substring(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1))
    return F.when(_full(core, "(?:[XYZ]|[0-9])[0-9]{7}[A-Z]"), F.when(letter == F.substring(core, 9, 1), "valid").otherwise("invalid"))


def fiscal_status(core: Column) -> Column:
    """Italian codice fiscale: the last letter is the sum of tabulated odd and plain even places, by 26."""
    odd = F.array(*(F.lit(x) for x in FISCAL_ODD))
    total = F.aggregate(
        F.transform(_chars(F.substring(core, 1, 15)), lambda c, i: F.when(i % 2 == 0, F.element_at(odd, _rank(c) + 1)).otherwise(F.when(c.rlike("^[0-9]"), _rank(c)).otherwise(_rank(c) - 10))),
        F.lit(0), lambda a, x: a + x,
    )
    return F.when(_full(core, FISCAL), F.when(F.char(F.lit(65) + total % 26) == F.substring(core, 16, 1), "valid").otherwise("invalid"))


def nir_status(core: Column) -> Column:
    """French social number of 15 characters: key = 97 - number mod 97, Corsican departments read as 19 and 18."""
    number = F.concat(F.substring(core, 1, 5), F.when(F.substring(core, 6, 2) == "2A", "19").when(F.substring(core, 6, 2) == "2B", "18").otherwise(F.substring(core, 6, 2)), F.substring(core, 8, 6)).cast("bigint")
    shaped = _full(core, "[12][0-9]{2}(?:0[1-9]|1[0-2]|[2-9][0-9])(?:[0-9]{2}|2[AB])[0-9]{8}")
    return F.when(shaped, F.when(97 - number % 97 == F.substring(core, 14, 2).cast("bigint"), "valid").otherwise("invalid"))


def steuer_idnr_status(core: Column) -> Column:
    """German tax number: ISO 7064 MOD 11,10, and of the first ten digits just one repeats, two or three times but not in a row."""
    first = F.substring(core, 1, 10)
    times = [F.length(first) - F.length(F.regexp_replace(first, str(d), "")) for d in range(10)]
    repeated = reduce(lambda a, b: a + b, (F.when(t > 1, 1).otherwise(0) for t in times))
    rule = (repeated == 1) & (F.greatest(*times) <= 3) & ~first.rlike(r"(.)\1\1")

    def fold(p: Column, c: Column) -> Column:
        s = (c.cast("int") + p) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    check = (11 - F.aggregate(_chars(first), F.lit(10), fold)) % 11
    return F.when(_full(core, "[1-9][0-9]{10}"), F.when(rule & (F.when(check == 10, 0).otherwise(check) == _digit(core, 11)), "valid").otherwise("invalid"))


def nino_status(core: Column) -> Column:
    """British insurance number: two letters from the allowed ranges, six digits, A-D."""
    return F.when(_full(core, "[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]"), F.when(F.substring(core, 1, 2).isin(*NINO_REFUSED), "invalid").otherwise("valid"))


def ssn_status(value: Column) -> Column:
    """US social security number with hyphens: area not 000, 666 or 900 and more; group and serial not all zero."""
    area = F.substring(value, 1, 3)
    bad = area.isin("000", "666") | (area >= "900") | (F.substring(value, 5, 2) == "00") | (F.substring(value, 8, 4) == "0000")
    return F.when(_full(value, "[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(bad, "invalid").otherwise("valid"))


def ahv_status(core: Column) -> Column:
    """Swiss insurance number of 13 digits from 756 on: EAN-13 check digit."""
    total = F.aggregate(F.transform(_chars(core), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return F.when(_full(core, "756[0-9]{10}"), F.when(total % 10 == 0, "valid").otherwise("invalid"))


def identifier_status(value: Column, label: Column) -> Column:
    """The status of a value under its label; n/a for labels without a format."""
    core = compact(value)
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    serial = F.when(F.length(core).between(5, 32), "valid").otherwise("invalid")
    plain_nir = F.when(_full(core, "[12][0-9]{14}"), F.when(97 - F.substring(core, 1, 13).cast("bigint") % 97 == F.substring(core, 14, 2).cast("bigint"), "valid").otherwise("invalid"))
    return (
        F.when(~_full(core, "[A-Z0-9]{3,34}") | (digits < 2), "invalid")
        .when(label == "IBAN", iban_status(value))
        .when(label == "CREDITCARDNUMBER", F.when(_full(core, "[0-9]{13,19}") & luhn_valid(core), "valid").otherwise("invalid"))
        .when(label == "IDCARDNUM", F.coalesce(dni_status(core), serial))
        .when(label == "TAXNUM", F.coalesce(dni_status(core), fiscal_status(core), F.lit("unknown")))
        .when(label == "SOCIALNUM", F.coalesce(ssn_status(F.trim(value)), ahv_status(core), plain_nir, F.lit("unknown")))
        .when(label == "ACCOUNTNUM", F.when(core.rlike("^[A-Z]{2}[0-9]{2}"), iban_status(value)).otherwise("unknown"))
        .when(label.isin("PASSPORTNUM", "DRIVERLICENSENUM"), serial)
        .when(label == "PERSONALREF", F.when(F.length(core) <= 32, "valid").otherwise("invalid"))
        .otherwise("n/a")
    )
