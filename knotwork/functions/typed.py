"""Reading typed values out of strings in differing notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.functions.text import squeeze

#: Month names and their usual short forms, by month. Fixed values.
MONTHS = (
    ("january", "jan", "januar", "janvier", "enero"),
    ("february", "feb", "februar", "février", "febrero"),
    ("march", "mar", "märz", "mars", "marzo"),
    ("april", "apr", "avril", "abril"),
    ("may", "mai", "mayo"),
    ("june", "jun", "juni", "juin", "junio"),
    ("july", "jul", "juli", "juillet", "julio"),
    ("august", "aug", "août", "agosto"),
    ("september", "sep", "sept", "septembre", "septiembre"),
    ("october", "oct", "okt", "oktober", "octobre", "octubre"),
    ("november", "nov", "novembre", "noviembre"),
    ("december", "dec", "dez", "dezember", "décembre", "diciembre"),
)


def full_date(value: Column) -> Column:
    """``YYYY-MM-DD`` where the value is one full, possible date, else null.

    Read are year-month-day with one of ``- . /`` (a time may follow), eight digits, day-month-year (days stand before
    months if the year comes last) and dates with a month's name.
    """
    text = squeeze(value)
    ymd = r"^(\d{4})([-./])(\d{1,2})\2(\d{1,2})(?:[T ]\d.*)?$"
    run = r"^(\d{4})(\d{2})(\d{2})$"
    dmy = r"^(\d{1,2})\s?[-./]\s?(\d{1,2})\s?[-./]\s?(\d{4})$"
    named = r"^(\d{1,2})\.?\s(\p{L}+)\.?\s(\d{4})$"
    turned = r"^(\p{L}+)\.?\s(\d{1,2}),?\s(\d{4})$"
    months = F.create_map(*[F.lit(x) for m, names in enumerate(MONTHS, 1) for n in names for x in (n, str(m))])
    by_name = lambda order: F.concat_ws("-", F.regexp_extract(text, r"(\d{4})$", 1), F.coalesce(months[F.lower(F.regexp_extract(text, r"(\p{L}+)", 1))], F.lit("0")), F.regexp_extract(text, order, 1))
    ordered = (
        F.when(text.rlike(ymd), F.regexp_replace(text, ymd, "$1-$3-$4"))
        .when(text.rlike(run), F.regexp_replace(text, run, "$1-$2-$3"))
        .when(text.rlike(dmy), F.regexp_replace(text, dmy, "$3-$2-$1"))
        .when(text.rlike(named), by_name(r"^(\d{1,2})"))
        .when(text.rlike(turned), by_name(r"\s(\d{1,2}),?\s"))
    )
    return F.date_format(ordered.try_cast("date"), "yyyy-MM-dd")


def euro_cents(value: Column) -> Column:
    """Cents of an amount with a written decimal part, else null.

    The last point or comma parts the decimals (two or more digits); other points, commas, apostrophes and spaces
    group thousands. A euro sign or ``EUR`` may stand on either side.
    """
    text = squeeze(value)
    amount = r"^(?iU)(?:EUR|€)?\s*(-?\d{1,3}(?:[.,'’\s]?\d{3})*|-?\d+)[.,](\d{2,})\s*(?:EUR|€)?$"
    whole = F.regexp_replace(F.regexp_extract(text, amount, 1), r"(?U)[.,'’\s]", "")
    exact = F.concat(whole, F.lit("."), F.substring(F.regexp_extract(text, amount, 2), 1, 6))
    return F.when(text.rlike(amount), F.round(exact.try_cast("decimal(30,6)") * 100, 0).try_cast("bigint"))
