"""Dates and times of appointments in texts of several languages.

Defined results: null texts have no slots; dates that no form fits stay as they are; lines shorter than
5 or longer than 200 characters are passed over; of slots with the same date and time the first counts;
slots are ordered by date, those of one date and those without one, which come last, as in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.selectors import let

#: Names of months by language, and short ones, accents left out.
MONTHS = (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "januar februar marz april mai juni juli august september oktober november dezember",
    "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "- - - - - - - - sept - - -",
)
#: Forms of dates and of times; the first that a line holds counts.
DATES = (
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\b",
    r"(?i)\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})\b",
    r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4})\b",
    r"(?i)\b(\d{1,2}\s+de\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\s+(?:de\s+)?\d{2,4})\b",
    r"(?i)\b(\d{1,2}\.\s*(?:Januar|Februar|Marz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+\d{2,4})\b",
)
TIMES = (r"(?i)\b(\d{1,2}[:.]?\d{2})\s*(?:h|hrs?|uhr)?\b", r"(?i)\b(\d{1,2}:\d{2}\s*(?:AM|PM))\b", r"\b(\d{1,2}[:.]?\d{2}\s*-\s*\d{1,2}[:.]?\d{2})\b")
SHORTEST, LONGEST, SHOWN = 5, 200, 100
#: Confidence of a slot with date and time, with a date, with a time.
BOTH, DATED, TIMED = 0.9, 0.7, 0.5


def month(name: Column) -> Column:
    """Number of a month by its name in six languages, as two digits, or null."""
    pairs = {n: f"{i:02d}" for names in MONTHS for i, n in enumerate(names.split(), 1) if n != "-"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), F.lower(name))


def iso_date(text: Column) -> Column:
    """A date as year-month-day: of day, month and year in numbers, or with a month's name before or after the day."""
    plain = F.trim(text)
    part = lambda form, i: F.nullif(F.regexp_extract(plain, form, i), F.lit(""))
    two = lambda digits: F.lpad(digits, 2, "0")
    numbers = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
    year = part(numbers, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") > 50, "19").otherwise("20"), year)).otherwise(year)
    first = r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    named = lambda form, d, m: F.concat(part(form, 3), F.lit("-"), month(part(form, m)), F.lit("-"), two(part(form, d)))
    behind = [rf"(?i)^(\d{{1,2}}){between}([a-z]+)\s+{of}(\d{{4}})$" for between, of in ((r"\s+", ""), (r"\s+de\s+", r"(?:de\s+)?"), (r"\.\s*", ""))]
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.coalesce(F.concat(full, F.lit("-"), two(part(numbers, 2)), F.lit("-"), two(part(numbers, 1))), named(first, 2, 1), *[named(b, 1, 2) for b in behind], text))


def first_of(line: Column, forms: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(line, f, 1), F.lit("")) for f in forms])


def time_slots(text: Column) -> Column:
    """Array of (date, time, raw, confidence) of the dates and times that lines of a text hold."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s).between(SHORTEST, LONGEST))
    found = F.transform(lines, lambda s: F.struct(first_of(s, DATES).alias("date"), first_of(s, TIMES).alias("time"), F.substring(s, 1, SHOWN).alias("raw")))
    some = F.filter(found, lambda x: x["date"].isNotNull() | x["time"].isNotNull())
    key = lambda x: F.concat_ws("-", F.coalesce(x["date"], F.lit("")), F.coalesce(x["time"], F.lit("")))
    once = let(some, lambda xs: let(F.transform(xs, key), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, key(x)) == i + 1)))
    sure = lambda x: F.when(x["date"].isNotNull() & x["time"].isNotNull(), BOTH).when(x["date"].isNotNull(), DATED).otherwise(TIMED)
    placed = F.transform(once, lambda x, i: F.struct(iso_date(x["date"]).isNull().alias("undated"), iso_date(x["date"]).alias("date"), i.alias("at"), x["time"].alias("time"), x["raw"].alias("raw"), sure(x).alias("confidence")))
    return F.transform(F.array_sort(placed), lambda x: F.struct(x["date"].alias("date"), x["time"].alias("time"), x["raw"].alias("raw"), x["confidence"].alias("confidence")))
