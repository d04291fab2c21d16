"""Text strings, dates, labels, ligatures, hyphens and writing direction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}


def text_string(data: Column) -> Column:
    """UTF-16 behind its mark FE FF, else UTF-8 with broken parts replaced."""
    rest = F.substring(data, F.lit(3), F.octet_length(data) - 2)
    return F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", F.decode(F.substring(rest, F.lit(1), F.octet_length(rest) - F.octet_length(rest) % 2), "UTF-16BE")).otherwise(F.make_valid_utf8(data.cast("string")))


def variant_text(value: Column, path: str) -> Column:
    """The text of a tagged string or name at a path."""
    return F.coalesce(text_string(F.unhex(F.try_variant_get(value, f"{path}.s", "string"))), F.try_variant_get(value, f"{path}.n", "string"))


def date_to_iso(text: Column) -> Column:
    """D:YYYYMMDDHHmmSSOHH'mm' as ISO 8601, as far as it goes; anything else stays as it is."""
    form = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?.*$"
    part = lambda i: F.regexp_extract(text, form, i)
    add = lambda i, before, default: F.when(part(i) != "", F.concat(F.lit(before), part(i))).otherwise(default)
    time = F.when(part(4) != "", F.concat(F.lit("T"), part(4), add(5, ":", ":00"), add(6, ":", ":00"), F.when(part(8) != "", F.concat(part(8), part(9), add(10, ":", ":00"))).otherwise("Z"))).otherwise("")
    return F.when(text.rlike(form), F.concat(part(1), add(2, "-", ""), add(3, "-", ""), time)).otherwise(text)


def iso_to_date(moment: Column) -> Column:
    """A timestamp as D:YYYYMMDDHHmmSSZ."""
    return F.concat(F.lit("D:"), F.date_format(moment, "yyyyMMddHHmmss"), F.lit("Z"))


def roman(n: Column) -> Column:
    """Upper-case numerals; thousands repeat M."""
    digits = [("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")]
    place = lambda table, by: F.get(F.array(*[F.lit(d) for d in table]), (F.floor(n / by) % 10).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(digits[0], 100), place(digits[1], 10), place(digits[2], 1))


def letters(n: Column) -> Column:
    """A to Z, then AA to ZZ: the letter repeats."""
    return F.repeat(F.chr(65 + (n - 1) % 26), F.ceil(n / 26).cast("int"))


def page_label(style: Column, prefix: Column, value: Column) -> Column:
    """A label of a range's style (D, R, r, A, a or none), prefix and number."""
    number = F.when(style == "D", value.cast("string")).when(style == "R", roman(value)).when(style == "r", F.lower(roman(value))).when(style == "A", letters(value)).when(style == "a", F.lower(letters(value))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), number)


def expand_ligatures(text: Column) -> Column:
    for one, many in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def join_hyphens(rows: Column) -> Column:
    """An array of rows: where one ends with a letter and a hyphen and the next begins in lower case, its first word moves up.

    An ordered fold, as the joined row may itself be continued.
    """

    def step(done: Column, row: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & last.rlike(r"\p{L}[-­‐]$") & row.rlike(r"^\p{Ll}")
        word, rest = F.regexp_extract(row, r"^(\S+)\s*(.*)$", 1), F.regexp_extract(row, r"^(\S+)\s*(.*)$", 2)
        up = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.substring(last, F.lit(1), F.length(last) - 1), word)))
        return F.when(joins, F.when(rest == "", up).otherwise(F.concat(up, F.array(rest)))).otherwise(F.concat(done, F.array(row)))

    return F.aggregate(rows, F.array().cast("array<string>"), step)


def _reordered(line: str) -> str:
    kinds = [unicodedata.bidirectional(c) for c in line]
    right, left = sum(k in ("R", "AL") for k in kinds), kinds.count("L")
    if not right:
        return line

    def back(part: str) -> str:
        """Reversed, but numbers and words of the other direction stay readable and brackets face the other way."""
        out, i, flipped = [], 0, part[::-1]
        swap = str.maketrans("()[]{}<>", ")(][}{><")
        while i < len(flipped):
            j = i
            while j < len(flipped) and unicodedata.bidirectional(flipped[j]) in ("EN", "AN", "L", "NSM") or j > i and j + 1 < len(flipped) and flipped[j] in ".,:/-" and flipped[j + 1].isdigit():
                j += 1
            out.append(flipped[i:j][::-1] if j > i else flipped[i].translate(swap))
            i = max(j, i + 1)
        return "".join(out)

    if right > left:
        return back(line)
    out, i = [], 0
    while i < len(line):
        j = i
        while j < len(line) and kinds[j] in ("R", "AL", "WS", "NSM", "EN", "AN", "CS", "ON") and any(k in ("R", "AL") for k in kinds[i : j + 1]):
            j += 1
        while j > i and kinds[j - 1] not in ("R", "AL", "NSM"):
            j -= 1
        out.append(back(line[i:j]) if j > i else line[i])
        i = max(j, i + 1)
    return "".join(out)


@pandas_udf(StringType())
def _bidi(lines: pd.Series) -> pd.Series:
    return lines.map(_reordered)


def reorder_bidi(line: Column) -> Column:
    """Lines with right-to-left letters in reading order; others never leave the JVM."""
    return F.when(line.rlike("[֐-ࣿיִ-﻿]"), _bidi(line)).otherwise(line)
