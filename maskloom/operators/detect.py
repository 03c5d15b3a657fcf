"""Detectors: text to spans.  The regex engine, and a registry of identifiers that carry their own check."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import checks
from maskloom.functions.rx import EMAIL, IBAN, find_spans, labelled_spans, render
from maskloom.operators import fixed
from maskloom.operators.intervals import greedy

_EDGE, _EDGE_AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


def regex_spans(text: Column) -> Column:
    """EMAIL and IBAN with a valid checksum, ordered and disjoint."""
    return greedy(F.concat(labelled_spans(text, EMAIL, "EMAIL"), labelled_spans(text, IBAN, "IBAN", checks.iban_valid)))


def mask_regex(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``entities`` and ``masked_text``; one narrow projection, the same on a stream."""
    return docs.withColumn("entities", regex_spans(F.col(text))).withColumn("masked_text", render(F.col(text), F.col("entities")))


@dataclass(frozen=True)
class Detector:
    """A pattern, the label of its matches, and the status of a match (null: not one)."""

    label: str
    pattern: str
    status: Callable[[Column], Column]
    default: bool = False


def _core(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Z0-9]", "")


# Printed forms of the identifiers.
DETECTORS: dict[str, Detector] = {
    "ch_ahv": Detector("SOCIALNUM", _EDGE + r"756([.  ])[0-9]{4}\1[0-9]{4}\1[0-9]{2}" + _EDGE_AFTER, lambda v: checks.ahv_status(_core(v))),
    "de_steuer_idnr": Detector("TAXNUM", _EDGE + r"(?<![0-9][-./ ])[1-9][0-9][ . ]?[0-9]{3}[ . ]?[0-9]{3}[ . ]?[0-9]{3}(?![-/]?[0-9])" + _EDGE_AFTER, lambda v: checks.steuer_idnr_status(_core(v))),
    "es_dni_nie": Detector("IDCARDNUM", _EDGE + r"(?:[XYZ][-. ]?[0-9]{7}|[0-9]{2}\.[0-9]{3}\.[0-9]{3}|[0-9]{8})[ -]?[A-Z]" + _EDGE_AFTER, lambda v: checks.dni_status(_core(v))),
    "fr_nir": Detector("SOCIALNUM", _EDGE + r"[12][ .  ]?[0-9]{2}[ .  ]?(?:0[1-9]|1[0-2]|[2-9][0-9])[ .  ]?(?:[0-9]{2}|2[AB])[ .  ]?[0-9]{3}[ .  ]?[0-9]{3}[ .  ]?[0-9]{2}" + _EDGE_AFTER, lambda v: checks.nir_status(_core(v)), True),
    "gb_nino": Detector("SOCIALNUM", _EDGE + r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][  -]?[0-9]{2}[  -]?[0-9]{2}[  -]?[0-9]{2}[  -]?[A-D]" + _EDGE_AFTER, lambda v: checks.nino_status(_core(v))),
    "it_codice_fiscale": Detector("TAXNUM", _EDGE + checks.FISCAL + _EDGE_AFTER, checks.fiscal_status, True),
    "us_ssn": Detector("SOCIALNUM", r"(?<![A-Za-z0-9.\-/])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9\-/]|[.,][0-9])", checks.ssn_status),
}
DEFAULT_DETECTORS = tuple(name for name, d in DETECTORS.items() if d.default)


#: Characters before an identifier where a business key is looked for, and a text that ends in one.
_NEAR = 120
_AFTER_KEY = r"(?iU)(?<!\w)(?:" + "|".join(k.replace(" ", r"\s+") for k in fixed.listed(fixed.BUSINESS_KEYS)) + r")(?:[ \t-]*(?:" + "|".join(fixed.listed(fixed.NUMBER_WORDS)) + r")[.°º]?)?(?!\w)[\s:=#]*$"


def identifier_spans(text: Column, enabled: tuple[str, ...] = DEFAULT_DETECTORS) -> Column:
    """Valid identifiers of the enabled detectors: array of (start, end, label, detector).

    What stands directly after the key of a business value (``order:``, ``invoice number:``) is none.
    """
    before = lambda m: F.substring(text, F.greatest(m["start"] - _NEAR, F.lit(0)) + 1, F.least(m["start"], F.lit(_NEAR)))

    def found(name: str, d: Detector) -> Column:
        hits = F.filter(find_spans(text, d.pattern), lambda m: (d.status(m["value"]) == "valid") & ~before(m).rlike(_AFTER_KEY))
        return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(d.label).alias("label"), F.lit(name).alias("detector")))

    return F.concat(*(found(name, DETECTORS[name]) for name in enabled))
