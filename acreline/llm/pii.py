"""PII: format-preserving Feistel pseudonyms, in SQL functions only.

Personal values are found by pattern, validated, and replaced by a keyed permutation of
themselves within their own format: a card number becomes another number with a right check
digit and the same separators, a date another date, an address another address. A Feistel
network is a permutation whatever its round function is, so different values stay different
and equal values stay equal, in one document and across documents. The round function is
SHA-256 of (key, kind, round, other half).
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The formats that count as personal data.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "date": r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d\-/])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "number": r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}"
              r"|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keystream(key: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), other), 256)


def _add(text: Column, stream: Column, letters: int) -> Column:
    """Shift every letter and digit of `text` within its own class by the key stream."""
    def shifted(c: Column, j: Column) -> Column:
        k = F.conv(F.substring(stream, 2 * (j % 32) + 1, F.lit(2)), 16, 10).cast("int")

        def turn(first: str, size: int) -> Column:
            return F.chr(F.pmod(F.ascii(c) - ord(first) + k, F.lit(size)) + ord(first))

        return (F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", letters))
                .when(c.between("A", "Z"), turn("A", letters)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), shifted), "")


def permuted_text(text: Column, key: str, letters: int = 26) -> Column:
    """Permute ASCII text so that every character keeps its class: digit, lower, upper, other."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"),
                     F.substring(text, half + 1, F.char_length(text)).alias("b"))

    def round_(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, _add(s["a"], _keystream(key, i, s["b"]), letters)).otherwise(s["a"]).alias("a"),
            F.when(odd, s["b"]).otherwise(_add(s["b"], _keystream(key, i, s["a"]), letters)).alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, state, round_, lambda s: F.concat(s["a"], s["b"]))


def permuted_int(value: Column, left: int | Column, right: int | Column, key: str) -> Column:
    """Permute an integer of 0 to left * right - 1 by a Feistel network over both factors."""
    state = F.struct((value / right).cast("long").alias("a"), (value % right).cast("long").alias("b"))

    def drawn(i: Column, other: Column) -> Column:
        return F.conv(F.substring(_keystream(key, i, other.cast("string")), 1, 12), 16, 10).cast("long")

    def round_(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (s["a"] + drawn(i, s["b"])) % left).otherwise(s["a"]).alias("a"),
            F.when(odd, s["b"]).otherwise((s["b"] + drawn(i, s["a"])) % right).alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, state, round_, lambda s: s["a"] * right + s["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order; separators stay."""
    def put(c: Column, j: Column) -> Column:
        nth = F.char_length(_digits(F.substring(template, F.lit(1), j + 1)))
        return F.when(c.between("0", "9"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), put), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; a number is valid when it is a multiple of ten."""
    def worth(c: Column, j: Column) -> Column:
        d = c.cast("int") * F.when(j % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, d: a + d)


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)
    body = permuted_text(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    whole = _refill(text, F.concat(body, check))
    return F.when(luhn_sum(digits) % 10 == 0, whole).otherwise(text)


#: Days of 400 Gregorian years, as two factors; the permutation stays in 1800 to 2199.
_DAYS = (189, 773)
_ERA = 1800
_LEAP = [y for y in range(400) if calendar.isleap(_ERA + y)]
_COMMON = [y for y in range(400) if not calendar.isleap(_ERA + y)]


def _whole_era(day: Column) -> Column:
    """The day, if all 400 years around it have four digits."""
    return F.when(F.year(day).between(_ERA % 400, 9999 - (9999 - _ERA) % 400 - 1), day)


def _date(text: Column, key: str) -> Column:
    """A date in its own notation. Slash dates are day-first where they can be.

    Dates that can be read day-first, and month-first ones that cannot, are permuted each among
    themselves, so no two dates get one pseudonym.
    """
    def moved(pattern: str) -> Column:
        day = _whole_era(F.try_to_timestamp(text, F.lit(pattern)).cast("date"))
        n = F.datediff(day, F.lit(f"{_ERA}-01-01").cast("date"))
        era = F.floor(n / (_DAYS[0] * _DAYS[1])) * (_DAYS[0] * _DAYS[1])
        new = F.date_add(F.lit(f"{_ERA}-01-01").cast("date"),
                         (permuted_int(n - era, *_DAYS, key) + era).cast("int"))
        return F.date_format(new, pattern)

    day_first = F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))
    return F.coalesce(moved("yyyy-MM-dd"), moved("dd/MM/yyyy"),
                      F.when(day_first.isNull(), _late_day(text, f"{key}|late")), text)


def _late_day(text: Column, key: str) -> Column:
    """Month-first dates whose day is no month (13 on), permuted among months of one length."""
    day = _whole_era(F.try_to_timestamp(text, F.lit("MM/dd/yyyy")).cast("date"))
    length, year = F.dayofmonth(F.last_day(day)), F.pmod(F.year(day) - _ERA, F.lit(400))
    listed = lambda items: F.array(*[F.lit(i) for i in items])
    months = (F.when(length == 31, listed([1, 3, 5, 7, 8, 10, 12])).when(length == 30, listed([4, 6, 9, 11]))
              .otherwise(listed([2])))
    # February alone depends on the year: of its length there are only some.
    years = F.when(length == 29, listed(_LEAP)).otherwise(listed(_COMMON))
    many = length >= 30
    slot = F.when(many, year * F.size(months) + F.array_position(months, F.month(day)) - 1).otherwise(
        F.array_position(years, year) - 1)
    slots = F.when(many, 400 * F.size(months)).otherwise(F.size(years))
    days = length - 12
    new = permuted_int(slot * days + F.dayofmonth(day) - 13, slots, days, key)
    at = F.floor(new / days).cast("int")
    new_year = F.when(many, F.floor(at / F.size(months))).otherwise(F.get(years, at))
    new_month = F.when(many, F.get(months, at % F.size(months))).otherwise(2)
    made = F.make_date((F.year(day) - year + new_year).cast("int"), new_month, (new % days + 13).cast("int"))
    return F.date_format(made, "MM/dd/yyyy")


def _ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    new = permuted_int(value, 65536, 65536, key)
    return F.concat_ws(".", *[F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def _phone(text: Column, key: str) -> Column:
    digits = _digits(text)
    lead = F.greatest(F.char_length(digits) - 10, F.lit(0))
    return _refill(text, F.concat(F.substring(digits, F.lit(1), lead),
                                  permuted_text(F.substring(digits, lead + 1, F.lit(10)), key)))


def _email(text: Column, key: str) -> Column:
    """Local part and domain are permuted apart, so that equal domains stay equal."""
    domain = F.substring_index(text, "@", -1)
    host = F.regexp_replace(domain, r"\.[A-Za-z]+$", "")
    return F.concat(permuted_text(F.substring_index(text, "@", 1), f"{key}|local"), F.lit("@"),
                    permuted_text(host, f"{key}|host"),
                    F.substring(domain, F.char_length(host) + 1, F.char_length(domain)))


def _secret(text: Column, key: str) -> Column:
    return permuted_text(text, key, letters=6)


_MAKERS = {"email": _email, "secret": _secret, "date": _date, "ip": _ip,
           "ssn": lambda t, k: _refill(t, permuted_text(_digits(t), k)), "number": _card, "phone": _phone}


def kind_of(value: Column) -> Column:
    """The kind of a value that was found, by its own format."""
    def whole(kind: str) -> str:
        # The surroundings were checked when the value was found.
        return f"^(?:{PATTERNS[kind]})$"

    out = F.when(value.rlike(whole(KINDS[0])), KINDS[0])
    for kind in KINDS[1:]:
        out = out.when(value.rlike(whole(kind)), kind)
    return out


def _times(kinds: str, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """`docs` with personal values in the text replaced, and how many of each kind.

    All columns stay; with `counts` there are also n_replaced and n_<kind> (a column of such a
    name is replaced). Numbers without a right check digit and impossible dates are left as
    they are. A NULL text stays NULL with counts 0; texts without personal values come out
    unchanged. Rows are handled one by one, without a shuffle: copies get equal texts.
    """
    def new(value: Column) -> Column:
        out = value
        for kind in reversed(KINDS):
            out = F.when(kind_of(value) == kind, _MAKERS[kind](value, f"{key}|{kind}")).otherwise(out)
        return out

    text = F.col(f"`{text_col}`")
    # Most texts have no digit at all and are done after one quick look.
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    found = docs.withColumn("_llm_hits", F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    has = F.coalesce(F.size("_llm_hits") > 0, F.lit(False))
    changed = found.withColumn("_llm_new", F.when(has, F.transform("_llm_hits", new)))
    gaps = changed.withColumn("_llm_gaps", F.when(has, F.split(text, ANY, -1)))
    joined = F.concat(
        F.array_join(F.transform("_llm_new", lambda v, j: F.concat(F.get("_llm_gaps", j), v)), ""),
        F.element_at("_llm_gaps", -1))
    tally = {}
    if counts:
        hit = F.transform(F.arrays_zip("_llm_hits", "_llm_new"),
                          lambda p: F.when(p["_llm_hits"] != p["_llm_new"], kind_of(p["_llm_hits"])))
        gaps = gaps.withColumn("_llm_kinds", F.when(has, hit))
        n = F.coalesce(F.size(F.filter("_llm_kinds", lambda k: k.isNotNull())), F.lit(0))
        tally["n_replaced"] = F.when(has, n).otherwise(0).cast("long")
        for kind in KINDS:
            tally[f"n_{kind}"] = F.when(has, _times("_llm_kinds", kind)).otherwise(0).cast("long")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in tally]
    where = docs.columns.index(text_col)
    where -= sum(c in tally for c in docs.columns[:where])
    keep.insert(where, F.when(has, joined).otherwise(text).alias(text_col))
    return gaps.select(*keep, *[v.alias(k) for k, v in tally.items()])
