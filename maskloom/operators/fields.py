"""Values that a field name announces: "Passport no: C01X00T47" and the like, in five languages.

A text is read once into a list of tokens (words, numbers, blanks, signs); names are looked up in a tree of their words, and
small readers then take a serial, a date, an age, a telephone number or an IBAN from the token after.  Where a value
ends depends on what was read so far, so this is one Arrow function per batch, for the texts that hold a digit at
all; it returns spans only.  Checksums, protection and the rest of arbitration follow as built-in functions over those spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions import checks
from maskloom.functions.rx import EMAIL, IBAN, labelled_spans, render
from maskloom.operators import fixed
from maskloom.operators.detect import DEFAULT_DETECTORS, identifier_spans
from maskloom.operators.intervals import promoted_label

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("context", T.StringType())]))
#: Longest serial in characters, its letters and digits, and separators in a row; letters of a first and of a later group without digits.
SERIAL_SPAN, SERIAL_CORE, SERIAL_GAP, FIRST_LETTERS, LATER_LETTERS = 100, 34, 12, 6, 3
#: Characters around an ambiguous name where other evidence counts.
BEFORE, AFTER = 240, 160
PHONE_PLAN = fixed.PHONE_PLAN

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_JOINTS = frozenset("-‐‑–.'’\"")
_SEPARATORS = frozenset(" \t\r\n\u00a0\u202f.-/‐‑–")
_APOSTROPHES = str.maketrans("’", "'")


def _words(name: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W\d_]+|[°º]", name.lower()))


def _tree(names: dict[str, str]) -> dict:
    """Nested dictionaries of the names' words; the empty word leads to what a name means."""
    root: dict = {}
    for name, meaning in names.items():
        node = root
        for w in _words(name):
            node = node.setdefault(w, {})
        node[""] = meaning
    return root


def _field_names() -> dict[str, str]:
    """Meaning by name: the label, with the marks of names that need more around them."""
    out = {}
    for line in fixed.FIELDS.split("\n"):
        label, _, names = line.partition(":")
        for name in fixed.listed(names) if names else ():
            plain = name.strip("[]*")
            out[plain] = label + "".join(mark for mark in "[*" if mark in name)
    return out


_FIELDS = _tree(_field_names())
_BIRTHS = _tree(dict.fromkeys(fixed.listed(fixed.BIRTH_WORDS), "birth"))
_BUSINESS = _tree(dict.fromkeys(fixed.listed(fixed.BUSINESS_KEYS), "business"))
_NUMBERS = frozenset(fixed.listed(fixed.NUMBER_WORDS))
_PERSONAL, _AGES, _LINKS, _UNITS, _THINGS = (frozenset(fixed.listed(x)) for x in (fixed.PERSONAL_WORDS, fixed.AGE_WORDS, fixed.AGE_LINKS, fixed.AGE_UNITS, fixed.AGED_THINGS))
_EXTENSIONS = frozenset(fixed.listed(fixed.EXTENSIONS))
_NOT_SERIAL = frozenset(fixed.NOT_SERIAL.split())
_MONTHS = frozenset(fixed.MONTHS.split())


class Reader:
    """The tokens of a text, and readers that start at a token; a reader gives the token after what it took, or None."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = _TOKEN.findall(text)
        self.low = [t.lower() for t in self.tokens]
        self.at = [0]
        for t in self.tokens:
            self.at.append(self.at[-1] + len(t))
        self.fields: dict[int, tuple[str, int]] = {}  # by first token: meaning, token after
        i = 0
        while i < len(self.tokens):
            found = self.name(_FIELDS, i) if self.starts_word(i) else None
            if found:
                self.fields[i] = found
                i = found[1]
            else:
                i += 1

    def kind(self, i: int) -> str:
        """a word, 0 number, blank, or the sign itself; nothing beyond the text."""
        if not 0 <= i < len(self.tokens):
            return ""
        c = self.tokens[i][0]
        return "a" if c.isalpha() else "0" if c in "0123456789" else " " if c.isspace() else c

    def starts_word(self, i: int) -> bool:
        return (self.kind(i) in ("a", "°")) and self.kind(i - 1) not in ("a", "0", "_")

    def name(self, tree: dict, i: int) -> tuple[str, int] | None:
        """The longest name that begins here, a number word after it included: its meaning and the token after."""
        best, node, j, lines = None, tree, i, 0
        while True:
            node = node.get(self.low[j]) if j < len(self.tokens) and self.kind(j) in ("a", "°", "º") else None
            if node is None:
                break
            j += 1
            if "" in node and self.kind(j) not in ("a", "0", "_"):
                best = node[""], j
            # between two words of a name stand blanks, a line end at most, or a joint
            while j < len(self.tokens) and (self.kind(j) == " " or self.tokens[j] in _JOINTS) and lines < 2:
                lines += self.tokens[j].count("\n")
                j += 1
        if best is None:
            return None
        j = best[1]
        while self.kind(j) == "-" or self.kind(j) == " " and "\n" not in self.tokens[j]:
            j += 1
        if self.kind(j) == "a" and self.low[j] in _NUMBERS and self.kind(j + 1) not in ("a", "0", "_"):
            end = j + 1
            while self.tokens[end : end + 1] and self.tokens[end] in ".°º":
                end += 1
            if self.low[j] != "n" or end > j + 1:
                return best[0], end
        return best[0], best[1] + (self.kind(best[1]) == ".")

    def gap(self, i: int) -> int:
        """The token after blanks and link signs."""
        while i < len(self.tokens) and self.kind(i) in (" ", ":", "=", "#"):
            i += 1
        return i

    def serial(self, i: int) -> int | None:
        """Groups of letters and digits with separators between.

        A group without a digit is short, in capitals and no common word.  A serial ends before the next field or key and
        at a blank line, and has two digits and three characters at least.
        """
        start, core, digits, end = i, 0, 0, None
        while i < len(self.tokens) and self.at[i] - self.at[start] <= SERIAL_SPAN:
            j = i
            while self.kind(j) == "0" or self.kind(j) == "a" and self.tokens[j].isascii():
                j += 1
            group = "".join(self.tokens[i:j])
            numbers = sum(c.isdigit() for c in group)
            most = FIRST_LETTERS if end is None else LATER_LETTERS
            if not group or core + len(group) > SERIAL_CORE or i in self.fields or self.kind(j) in (":", "=", "a", "_"):
                break
            if not numbers and (group != group.upper() or group in _NOT_SERIAL or len(group) > most):
                break
            end, core, digits, i = j, core + len(group), digits + numbers, j
            while i < len(self.tokens) and all(c in _SEPARATORS for c in self.tokens[i]):
                i += 1
            between = self.text[self.at[end] : self.at[i]]
            if not between or len(between) > SERIAL_GAP or "\n\n" in between:
                break
        return end if digits >= 2 and core >= 3 else None

    def number(self, i: int, least: int, most: int) -> bool:
        return self.kind(i) == "0" and least <= len(self.tokens[i]) <= most

    def blanks(self, i: int, line_end: bool = False) -> int:
        return i + 1 if self.kind(i) == " " and (line_end or "\n" not in self.tokens[i]) else i

    def date(self, i: int) -> int | None:
        """Day, month and year as numbers with one sign between, or with the month's name."""
        if self.kind(i) == "a":  # May 3, 1985
            j = self.blanks(i + 1)
            if self.low[i] not in _MONTHS or j == i + 1 or not self.number(j, 1, 2):
                return None
            j = j + 2 if self.kind(j + 1) == "," else j + 1
            k = self.blanks(j)
            return k + 1 if k > j and self.number(k, 4, 4) else None
        if not self.number(i, 1, 4):
            return None
        j = self.blanks(i + 1)
        sign = self.kind(j)
        if sign == "." and self.low[(k := self.blanks(j + 1)) : k + 1] and self.low[k] in _MONTHS:  # 3. Mai 1985
            j, sign = k, "a"
        if sign == "a":
            k = self.blanks(j + 1)
            return k + 1 if self.low[j] in _MONTHS and j > i + 1 and k > j + 1 and self.number(i, 1, 2) and self.number(k, 4, 4) else None
        if sign not in ("-", "/", ".", "·"):
            return None
        month = self.blanks(j + 1)
        second = self.blanks(month + 1)
        last = self.blanks(second + 1)
        whole = self.number(month, 1, 2) and self.kind(second) == sign
        by_year = self.number(i, 4, 4) and self.number(last, 1, 2)
        by_day = self.number(i, 1, 2) and self.number(last, 2, 4)
        return last + 1 if whole and (by_year or by_day) and self.kind(last + 1) not in ("a", "_") else None

    def age(self, i: int) -> tuple[int, int] | None:
        """First token and the one after of an age that the word here announces."""
        if i >= 2 and self.blanks(i - 1) == i:
            owner = i - 4 if i >= 4 and self.low[i - 2] == "s" and self.tokens[i - 3] in "'’" else i - 2
            if self.low[owner] in _THINGS:
                return None
        j = self.blanks(i + 1)
        if self.kind(j) in (":", "=") or self.kind(j) == "a" and self.low[j] in _LINKS:
            j += 1
        j = self.blanks(j, line_end=True)
        if not self.number(j, 1, 3) or self.kind(j + 1) in ("a", "_"):
            return None
        unit = self.blanks(j + 1)
        return j, unit + 1 if unit > j + 1 and self.kind(unit) == "a" and self.low[unit] in _UNITS else j + 1

    def extension(self, i: int) -> int | None:
        """``ext. 12`` and the like."""
        while self.kind(i) in (",", ";", "/", "-") or self.kind(i) == " " and "\n" not in self.tokens[i]:
            i += 1
        if i >= len(self.tokens) or self.low[i] not in _EXTENSIONS:
            return None
        i += 1
        while self.kind(i) in (".", ":", "=", "-") or self.kind(i) == " " and "\n" not in self.tokens[i]:
            i += 1
        return i + 1 if self.number(i, 1, 8) else None

    def phone(self, i: int) -> tuple[int, bool] | None:
        """Digits with blanks, points, hyphens and brackets between, from a digit, a plus or a bracket on: the token after, and whether they are as many as a number has."""
        j, end = i, None
        while self.kind(j) in ("0", "(", ")", ".", "-") or self.kind(j) == "+" and (j == i or j == i + 1 and self.kind(i) == "(") or self.kind(j) == " " and "\n" not in self.tokens[j]:
            if self.kind(j) == "0" or self.kind(j) == ")":
                end = j + 1
            j += 1
        if end is None or self.kind(end) == "a" or self.kind(i - 1) in ("a", "0"):
            return None
        return end, 7 <= sum(len(t) for t in self.tokens[i:end] if t[0] in "0123456789") <= 17

    def coded(self, i: int, end: int) -> bool:
        """Whether letters hang on to the tokens, as in a part number."""
        for j, step in ((i - 1, -1), (end, 1)):
            while self.kind(j) in ("a", "0", "_", ".", "-", "/", "‐", "‑"):
                if self.kind(j) == "a":
                    return True
                j += step
        return False

    def business_before(self, i: int) -> bool:
        """Whether a business key stands directly before this token."""
        while i > 0 and self.kind(i - 1) in (" ", ":", "=", "#"):
            i -= 1
        return any(self.starts_word(j) and (found := self.name(_BUSINESS, j)) is not None and found[1] >= i for j in range(max(0, i - 8), i))

    def person_near(self, i: int) -> bool:
        """Whether the block of text around an ambiguous name speaks of a person's documents, by a word or another field."""
        lo, hi = max(0, self.at[i] - BEFORE), self.at[i] + AFTER
        lo = max(lo, self.text.rfind("\n\n", 0, self.at[i]) + 1)
        blank = self.text.find("\n\n", self.at[i])
        hi = min(hi, blank if blank >= 0 else len(self.text))
        near = range(next(k for k in range(len(self.at)) if self.at[k] >= lo), i), range(i + 1, len(self.tokens))
        documents = ("PASSPORTNUM", "IDCARDNUM", "DRIVERLICENSENUM", "TAXNUM", "SOCIALNUM")
        return any(self.low[k] in _PERSONAL or self.fields.get(k, ("",))[0] in documents for part in near for k in part if self.at[k] < hi)


def _iban(reader: Reader, i: int) -> int | None:
    """An IBAN of a known country that begins with this word, in groups of any kind; the token after."""
    spec = checks.IBAN_SPECS.get(reader.text[reader.at[i] : reader.at[i] + 2].upper())
    if spec is None:
        return None
    core, j = "", i
    while j < len(reader.tokens) and len(core) < spec[0]:
        t = reader.tokens[j]
        if reader.kind(j) in ("a", "0") and t.isascii():
            core += t
        elif not (len(t) <= 6 and all(c in _SEPARATORS and c not in "/\r\n" for c in t)):
            break
        j += 1
    whole = len(core) == spec[0] and reader.kind(j) not in ("a", "0") and reader.kind(j - 1) in ("a", "0")
    return j if whole and core[2:4].isdigit() and re.fullmatch(spec[1], core[4:].upper()) else None


def phone_possible(value: str) -> bool:
    """Whether the digits fit the plan of one of the regions, written internationally or nationally."""
    reader = Reader(value)
    cut = next((i for i in range(len(reader.tokens)) if reader.extension(i)), len(reader.tokens))
    digits = value[: reader.at[cut]].replace("(0)", "").strip()
    abroad = digits.lstrip("(").startswith(("+", "00"))
    digits = "".join(c for c in digits if c in "0123456789")
    if abroad:
        digits = digits.removeprefix("00")
        return any(digits.startswith(code) and low <= len(digits) - len(code) <= high for code, (low, high) in PHONE_PLAN.items())
    national = digits.removeprefix("0")
    return any(low <= len(national) <= high for low, high in PHONE_PLAN.values())


def field_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, label, context) of all announced values of a text."""
    r = Reader(text)
    out: list[tuple[int, int, str, str]] = []
    anchors = set()

    def found(i: int, end: int, label: str, context: str) -> None:
        out.append((r.at[i], r.at[end], label, context))

    for i, (meaning, after) in r.fields.items():
        label, start = meaning.strip("[*"), r.gap(after)
        linked = start > after and any(r.kind(k) in (":", "=") for k in range(after, start)) or r.low[after - 1] in _NUMBERS or r.tokens[after - 1] in ".°º"
        if "[" in meaning and not linked or "*" in meaning and not r.person_near(i):
            continue
        if label == "TELEPHONENUM":
            anchors.add(start)
        elif (end := r.serial(start)) is not None:
            found(start, end, label, "personal")
    i = 0
    while i < len(r.tokens):
        if r.starts_word(i):
            if birth := r.name(_BIRTHS, i):
                j = r.blanks(birth[1])
                j = r.blanks(j + 1) if r.kind(j) in (":", "=") else r.blanks(j, line_end=True)
                if (end := r.date(j)) is not None:
                    found(j, end, "DATEOFBIRTH", "personal")
            if r.low[i] in _AGES and (age := r.age(i)):
                found(*age, "AGE", "personal")
            if (end := _iban(r, i)) is not None:
                found(i, end, "IBAN", "unknown")
        if (r.kind(i) in ("+", "(") or r.kind(i) == "0") and (run := r.phone(i)) is not None:
            end, fits = run
            anchored = i in anchors
            value = r.text[r.at[i] : r.at[end]]
            groups = sum(r.kind(k) == "0" for k in range(i, end))
            abroad = value.lstrip("(").startswith(("+", "00"))
            free = fits and not r.coded(i, end) and (anchored or not r.business_before(i) and r.date(i) != end)
            if free and (anchored or abroad or value[0] in "0(" and groups > 2 and phone_possible(value)):
                found(i, r.extension(end) or end, "TELEPHONENUM", "personal" if anchored else "unknown")
            i = end
            continue
        i += 1
    return once_per_label(out)


def once_per_label(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Each (start, end, label) once, and no span that one of its label before it reaches over."""
    reach: dict[str, int] = {}
    out = []
    for s in sorted({f[:3]: f for f in found}.values(), key=lambda f: (f[0], -f[1], f[2])):
        if s[1] > reach.get(s[2], -1):
            out.append(s)
            reach[s[2]] = s[1]
    return sorted(out)


@F.pandas_udf(SPANS)
def _announced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: [{"start": a, "end": b, "label": x, "context": c} for a, b, x, c in field_spans(t)] if t else [])


def announced(text: Column | str) -> Column:
    """Announced values of a text: array of (start, end, label, context); a text without a digit has none and isn't sent to Python."""
    text = F.col(text) if isinstance(text, str) else text
    return _announced(F.when(text.rlike("[0-9]"), text))


def _candidate(s: Column, source: str, validation: Column, context: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(source).alias("source"), validation.alias("validation"), context.alias("context"), ((context == "personal") & (validation == "valid")).alias("protected"))


def candidates(text: Column, announced_spans: Column, enabled: tuple[str, ...] = DEFAULT_DETECTORS) -> Column:
    """The ledger of a text: regex engine, announced values with their status, identifiers that carry their own check."""
    regex = F.concat(labelled_spans(text, EMAIL, "EMAIL"), labelled_spans(text, IBAN, "IBAN", checks.iban_valid))
    value = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    status = lambda s: F.when(s["label"] == "TELEPHONENUM", "unknown").otherwise(checks.identifier_status(value(s), s["label"]))
    return F.concat(
        F.transform(regex, lambda s: _candidate(s, "regex", F.lit("n/a"), F.lit("unknown"))),
        F.transform(announced_spans, lambda s: _candidate(s, "structured", status(s), s["context"])),
        F.transform(identifier_spans(text, enabled), lambda s: _candidate(s, "structured", F.lit("valid"), F.lit("unknown"))),
    )


def union_ledger(ledger: Column) -> Column:
    """The union of a row's candidates, touching ones included: array of (start, end, label), label promoted to an enclosing region."""
    order = F.array_sort(F.transform(ledger, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), c["label"].alias("label"), c["end"].alias("end"))))
    kind = "array<struct<start:int,back:int,label:string,end:int>>"
    empty = F.array().cast(f"array<struct<reach:int,items:{kind}>>")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.greatest(last["reach"], x["end"]).alias("reach"), F.concat(last["items"], F.array(x)).alias("items"))))
        return F.when(last.isNotNull() & (x["start"] <= last["reach"]), joined).otherwise(F.concat(a, F.array(F.struct(x["end"].alias("reach"), F.array(x).alias("items")))))

    groups = F.aggregate(order, empty, step)
    return F.transform(groups, lambda g: F.struct(g["items"][0]["start"].alias("start"), g["reach"].alias("end"), promoted_label(g["items"]).alias("label")))


def mask_structured(docs: DataFrame, text: str = "text", enabled: tuple[str, ...] = DEFAULT_DETECTORS) -> DataFrame:
    """Adds ledger, entities, masked_text and counts by source; narrow, one Python step, the same on a stream."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("announced", announced(t))
    out = out.withColumn("ledger", candidates(t, F.col("announced"), enabled)).drop("announced")
    out = out.withColumn("entities", union_ledger(F.col("ledger"))).withColumn("masked_text", render(t, F.col("entities")))
    count = lambda cond: F.size(F.filter("ledger", cond))
    return out.withColumn("diagnostics", F.struct(count(lambda c: c["source"] == "regex").alias("regex_candidates"), count(lambda c: c["source"] == "structured").alias("structured_candidates"), count(lambda c: c["protected"]).alias("protected_candidates"), F.size("entities").alias("final_entities")))


def register_functions(spark) -> None:
    """The SQL function ``pii_fields(text)``: announced values as an array of spans."""
    spark.udf.register("pii_fields", _announced)
