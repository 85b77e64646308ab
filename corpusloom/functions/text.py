"""Scalar text functions: folding, identifiers, dates, thresholds, tokens, answer cleaning."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, GAP = "\x01", "\x02"


def _plain_forms() -> tuple[str, str, str]:
    """What becomes of each character outside ASCII once compatibility forms are taken apart and the rest is dropped.

    Characters that become one ASCII character, and what they become; those that become none follow
    in the first string only, but for those outside the basic plane. Third: the ones that become several, as a map for ``str_to_map``.
    """
    one, becomes, none, several = ["đ", "Đ"], ["d", "D"], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        base = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if c in "đĐ":
            continue
        if len(base) == 1:
            one.append(c), becomes.append(base)
        elif base:
            several.append(f"{c}{GAP}{base}")
        elif unicodedata.combining(c):
            none.append(c)
    return "".join(one + none), "".join(becomes), MARK.join(several)


MARKED, PLAIN, SEVERAL = _plain_forms()
_LONG = "[" + "".join(x[0] for x in SEVERAL.split(MARK)) + "]"


def ascii_form(text: Column) -> Column:
    """``text`` without marks, in ASCII: compatibility forms are taken apart, đ is d, and whatever has no plain form is dropped."""
    table = F.str_to_map(F.lit(SEVERAL), F.lit(MARK), F.lit(GAP))
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")
    plain = F.translate(F.when(text.rlike(_LONG), spread).otherwise(text), MARKED, PLAIN)
    return F.regexp_replace(plain, r"[^\x00-\x7F]+", "")


def fold(text: Column, keep: str = "") -> Column:
    """Lower case, marks removed, runs of other characters than a-z, 0-9 and ``keep`` as one space."""
    return F.trim(F.regexp_replace(F.lower(ascii_form(text)), f"[^a-z0-9{keep}]+", " "))


def fold_text(text: Column) -> Column:
    """``fold`` that keeps what identifiers of laws hold; empty for null."""
    return fold(F.coalesce(text, F.lit("")), "/_-")


def slug(text: Column, size: int | None = None, join: str = "-") -> Column:
    out = F.replace(fold(text), F.lit(" "), F.lit(join))
    return F.substring(out, 1, size) if size else out


def _unmarked() -> tuple[str, str]:
    """Letters whose canonical form is one character and marks, and that character; then the marks, to be dropped."""
    one, becomes, none = ["đ", "Đ"], ["d", "d"], []
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0x10000)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not base:
            none.append(c)
        elif len(base) == 1 and base != c:
            one.append(c), becomes.append(base)
    return "".join(one + none), "".join(becomes)


WITH_MARKS, WITHOUT = _unmarked()


def normalised(text: Column) -> Column:
    """Lower case without marks and with single blanks; punctuation and other scripts stay."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, WITH_MARKS, WITHOUT)), r"(?U)\s+", " "))


def tokens(text: Column, ascii_only: bool = True) -> Column:
    """Word tokens; ``ascii_only`` splits at letters with marks, otherwise they are letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+" if ascii_only else r"(?U)\w+"), F.lit(0))


def roman(numeral: Column) -> Column:
    """Value of a Roman numeral: a smaller digit before a larger one counts negative."""
    digit = F.create_map(*(F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in pair))
    step = lambda acc, c: F.struct((acc["sum"] + F.when(digit[c] < acc["top"], -digit[c]).otherwise(digit[c])).alias("sum"), F.greatest(acc["top"], digit[c]).alias("top"))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    return F.aggregate(F.split(F.reverse(numeral), ""), zero, lambda a, c: F.when(c == "", a).otherwise(step(a, c)), lambda a: a["sum"])


def event_date(text: Column, mode: str = "documented") -> Column:
    """The latest date that a text names, null without one.

    ``documented``: full dates d/m/y (or with dots or dashes) win over bare years, and years inside
    dates and law codes (``41/2024/QH15``) don't count. ``compat``: the latest of both, and every
    year from 1950 to 2099 counts, as the last day of that year. Days that don't exist are left out.
    """
    full = r"(?U)\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b"
    part = lambda i: F.regexp_extract_all(text, F.lit(full), F.lit(i))
    listed = F.zip_with(F.zip_with(part(3), part(2), lambda y, m: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))), part(1), lambda ym, d: F.concat(ym, F.lit("-"), F.lpad(d, 2, "0")))
    dates = F.array_max(F.transform(listed, lambda x: F.try_to_date(x, "yyyy-MM-dd")))
    rest = text if mode == "compat" else F.regexp_replace(F.regexp_replace(text, full, " "), r"\d+/\d+/[0-9A-Za-z]+", " ")
    found = F.regexp_extract_all(rest, F.lit(r"(?U)\b(19[5-9]\d|20\d{2})\b"), F.lit(1))
    years = F.array_max(F.transform(found, lambda y: F.make_date(y.cast("int"), F.lit(12), F.lit(31))))
    return F.greatest(dates, years) if mode == "compat" else F.coalesce(dates, years)


# The units of amounts.
UNITS = "%|tuổi|tháng|năm|ngày|lần"


def thresholds(text: Column, units: str = UNITS) -> Column:
    """Distinct amounts with a unit, full dates and years, in that order.

    Amounts may have one decimal comma or point and any blanks before the unit, which are returned
    as one; the unit may be in any case, and a letter or digit must follow a ``%`` (a word ends there).
    """
    amount = rf"(?Uiu)\b\d+(?:[,.]\d+)?\s*(?:{units})\b"
    amounts = F.transform(F.regexp_extract_all(text, F.lit(amount), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    others = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b", r"(?U)\b(?:19|20)\d{2}\b"))
    return F.array_distinct(F.concat(amounts, *others))


def clean_answer(answer: Column, plain: Column | None = None) -> Column:
    """The plain answer if there is one, else the answer without bracketed parts, whole citation lines, labels and spare blanks."""
    text = F.coalesce(answer, F.lit(""))
    text = F.regexp_replace(text, r"\[[^\]]+\]", "")
    text = F.regexp_replace(text, r"(?imu)^\s*(?:citation|citations|nguồn)\s*:.*$", "")
    text = F.regexp_replace(text, r"(?im)^\s*(?:issue|rule|application|conclusion)\s*:\s*", "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.coalesce(F.nullif(F.trim(plain), F.lit("")), text) if plain is not None else text


def category(codes: Column, corpus: list[str]) -> Column:
    """in_corpus, mixed, ooc (out of corpus) or unparseable, from the codes that a citation names."""
    known = F.size(F.filter(codes, lambda c: c.isin(corpus)))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, "unparseable").when(known == F.size(codes), "in_corpus").when(known == 0, "ooc").otherwise("mixed")


def clip(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.substring(text, 1, size)).otherwise(text)
