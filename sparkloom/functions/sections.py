"""Sections of two versions of a text: added, modified by similarity, and removed.

Defined results: null texts have no sections; sections that differ in white space alone are the same;
an added section takes the first old one with a similarity above one half, so two may take the same;
reports hold the first 200 characters of a section, as what is removed is told by them. Work within a
pair grows with the product of its changed and its other sections.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.selectors import let

CHANGE = "struct<type:string,old:string,new:string,significance:string>"
#: Words of changes that matter much, or somewhat; least similarity of versions of a section; characters of a section in a report.
HIGH = "requirement required must mandatory deadline fee cost price income minimum maximum visa permit application document effective valid expire".split()
MEDIUM = "may should recommend option alternative process step procedure".split()
SIMILAR, SHOWN = 0.5, 200


def sections(text: Column) -> Column:
    """Parts of a text between empty lines, without blank ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda s: s.rlike(r"\S"))


def plain(section: Column) -> Column:
    return F.trim(F.regexp_replace(section, r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Share of common words among all words of two sections, A-Z as a-z."""
    words = lambda s: F.array_distinct(F.split(F.lower(s), r"\s+"))
    return let(F.array(words(a), words(b)), lambda w: F.size(F.array_intersect(w[0], w[1])) / F.size(F.array_union(w[0], w[1])))


def similar_section(target: Column, among: Column) -> Column:
    """The first section that is a version of another, or null."""
    return F.get(F.filter(among, lambda s: similarity(target, s) > SIMILAR), F.lit(0))


def significance(section: Column) -> Column:
    low = F.lower(section)
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(HIGH), "high").when(has(MEDIUM), "medium").otherwise("low")


def section_changes(old: Column, new: Column) -> Column:
    """Array of (type, old, new, significance): added and modified sections in the order of the new text, then removed ones in that of the old."""
    shown = lambda s: F.substring(s, 1, SHOWN)
    none = F.lit(None).cast("string")
    of = lambda kind, a, b, s: F.struct(kind.alias("type"), a.alias("old"), b.alias("new"), significance(s).alias("significance"))

    def over(a: Column, b: Column) -> Column:
        known = lambda xs: F.transform(xs, plain)
        fresh = let(known(a), lambda have: F.filter(b, lambda s: ~F.array_contains(have, plain(s))))
        came = F.transform(fresh, lambda s: let(similar_section(s, a), lambda was: of(F.when(was.isNull(), "added").otherwise("modified"), shown(was), shown(s), s)))

        def with_removed(came: Column) -> Column:
            taken = F.transform(came, lambda c: c["old"])
            gone = let(known(b), lambda have: F.filter(a, lambda s: ~F.array_contains(have, plain(s)) & ~F.coalesce(F.array_contains(taken, shown(s)), F.lit(False))))
            return F.concat(came, F.transform(gone, lambda s: of(F.lit("removed"), shown(s), none, s)))

        return let(came, with_removed)

    return let(sections(old), lambda a: let(sections(new), lambda b: over(a, b)))


def summary(changes: Column) -> Column:
    """A sentence on an array of changes."""
    number = lambda test: F.size(F.filter(changes, test))
    part = lambda kind: let(number(lambda c: c["type"] == kind), lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit(" section"), F.when(n > 1, "s").otherwise(""), F.lit(f" {kind}"))))
    much = let(number(lambda c: c["significance"] == "high"), lambda n: F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(" high-significance change"), F.when(n > 1, "s").otherwise(""), F.lit(")"))).otherwise(""))
    return F.when(F.size(changes) == 0, "No significant changes detected").otherwise(F.concat(F.concat_ws(", ", part("added"), part("removed"), part("modified")), much))
