"""Column expressions over labels, callouts, periods and sheet references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.constraints import text_survives


def normalise(label: Column) -> Column:
    """Trimmed, runs of white space as one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))


def callout(text: Column) -> tuple[Column, Column]:
    """Name and number of 'Name (1,234.5)'; nulls where the text has another form."""
    body = F.trim(text)
    inside = F.rtrim(F.substring_index(body, "(", -1))  # what follows the last parenthesis
    name = F.nullif(F.trim(F.left(body, F.length(body) - F.length(F.substring_index(body, "(", -1)) - 1)), F.lit(""))
    number = F.replace(F.left(inside, F.length(inside) - 1), F.lit(","), F.lit("")).try_cast("double")
    whole = inside.endswith(")") & F.contains(body, F.lit("(")) & number.isNotNull() & name.isNotNull()
    return F.when(whole, name), F.when(whole, number)


def cell_reference(text: Column) -> tuple[Column, Column]:
    """Column letters and row number of a sheet reference such as 'AB12'; nulls for other texts."""
    letters, digits = F.translate(text, "0123456789", ""), F.translate(F.upper(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    whole = (F.length(letters) > 0) & (F.length(digits) > 0) & (F.concat(letters, digits) == text)
    return F.when(whole, letters), F.when(whole, digits.try_cast("int"))


def column_index(letters: Column) -> Column:
    """1-based index of sheet column letters: A..Z, AA..ZZ and on."""
    chars = F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(chars, F.lit(0), lambda n, x: n * 26 + x)


def classify(label: Column, dimension: dict[str, str], otherwise: str = "UNCLASSIFIED") -> Column:
    """Class of a label by a small fixed dimension of normalised names; others are named, not dropped."""
    known = F.create_map(*[F.lit(x) for pair in dimension.items() for x in pair])
    return F.coalesce(F.try_element_at(known, normalise(label)), F.lit(otherwise))


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(name, F.lit(3))))
    return F.when(at > 0, at.cast("int"))


def period(label: Column) -> tuple[Column, Column]:
    """First and last month of a period label, as first days; nulls where it has no known form.

    Forms: 'Mar 1997', 'March 1997', 'Mar-97' (with or without words before), 'Jan-Mar 1997', 'Jan 1996 - Mar 1997',
    '1st March 1997'. Two-digit years are those from 1951 to 2050.
    """
    name, year = r"([A-Za-z]{3,9})", r"(\d{4}|\d{2})"
    form = rf"(?:^|\s)(?:\d{{1,2}}(?:st|nd|rd|th)\s+)?{name}(?:[ -]{year})?(?:\s*-\s*{name}[ -]{year})?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim(label), form, k), F.lit(""))
    full = lambda y: F.when(F.length(y) == 2, F.when(y.cast("int") > 50, 1900).otherwise(2000) + y.cast("int")).otherwise(y.cast("int"))
    last_year = full(F.coalesce(part(4), part(2)))
    first, last = F.make_date(full(F.coalesce(part(2), part(4))), _month_number(part(1)), F.lit(1)), F.make_date(last_year, _month_number(F.coalesce(part(3), part(1))), F.lit(1))
    whole = first.isNotNull() & last.isNotNull() & (first <= last)
    return F.when(whole, first), F.when(whole, last)


def month_of_label(label: Column) -> Column:
    """First day of the month in 'Average of Mar-24' or 'Mar-24'; null otherwise."""
    return F.to_date(F.try_to_timestamp(F.concat(F.lit("01-"), F.nullif(F.regexp_extract(label, r"([A-Z][a-z]{2}-\d{2})\s*$", 1), F.lit(""))), F.lit("dd-MMM-yy")))


def column_letter(index: Column) -> Column:
    """Sheet column of a 1-based index up to 702: A..Z, AA..ZZ."""
    last = F.char(F.lit(65) + (index - 1) % 26)
    return F.when(index <= 26, last).otherwise(F.concat(F.char(F.lit(64) + F.floor((index - 1) / 26).cast("int")), last))


def flags(text: Column) -> Column:
    """Flags of 'A|B;C' as an array; empty text has none."""
    return F.filter(F.split(text, r"[|;]"), lambda x: x != "")


def safe_number(text: Column, kind: str) -> Column:
    """'' is null, never zero; other text must be a number of the kind."""
    return F.nullif(text, F.lit("")).cast(kind)


def canonical_class(raw: Column) -> Column:
    """'NON - MD  1 ' -> 'NON-MD1': upper case, no blanks around hyphens or before digits, single blanks."""
    out = F.upper(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    return F.regexp_replace(F.regexp_replace(out, r" ?- ?", "-"), r" (\d)", "$1")


def split_class(canonical: Column) -> tuple[Column, Column]:
    """Band and metering class of 'A NON-MD1'; a class without a band has a null band."""
    band = F.nullif(F.regexp_extract(canonical, r"^([A-E]) ", 1), F.lit(""))
    return band, F.regexp_replace(canonical, r"^[A-E] ", "")


def segments(text: Column, mark: str) -> Column:
    """Texts between marks, without empty ones."""
    return F.filter(F.transform(F.split(text, mark), lambda x: F.trim(x)), lambda x: x != "")


def tariff_class(raw: Column) -> tuple[Column, Column]:
    """Band and metering class of a published class label; both null where the label is outside the domain.

    A label is a band, a dash of any kind and a class: 'a – MD 1', 'B -Non-MD', 'C - md2 special'; or the lifeline class,
    which has no band of its own. Case, blanks and the hyphens inside a class don't count.
    """
    plain = F.upper(F.trim(F.regexp_replace(F.translate(raw, "–—", "--"), r"\s+", " ")))
    band = F.regexp_extract(plain, r"^([A-E]) ?-", 1)
    rest = F.regexp_replace(F.regexp_extract(plain, r"^[A-E] ?-(.*)$", 1), "[ -]", "")
    known = F.when(rest == "NONMD", "NON_MD").when(rest.isin("MD1", "MD2"), rest).when(rest == "MD2SPECIAL", "MD2_SPECIAL")
    lifeline = plain.rlike("^LIFE ?-? ?LINE")
    return F.when(lifeline, "LIFELINE").when(known.isNotNull(), band), F.when(lifeline, "NON_MD").otherwise(known)


def number_text(text: Column, kind: str) -> Column:
    """The number of a cell's text, if the text is a plain number that the type gives back; null for truth values, words, blanks and longer numbers."""
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$") & text_survives(text, kind), text.try_cast(kind))


def known_columns(sheet: DataFrame, known: list[str], left_out: list[str]) -> DataFrame:
    """The known columns of a sheet. Columns that are left out by name go; any other column, and a known one that lacks, is refused."""
    unknown, lacking = sorted(set(sheet.columns) - {*known, *left_out}), sorted(set(known) - set(sheet.columns))
    if unknown or lacking:
        raise ValueError(f"unknown columns: {', '.join(unknown) or 'none'}; lacking: {', '.join(lacking) or 'none'}")
    return sheet.select(*known)
