"""Functions over a text's lines as an array, without exploding or shuffling it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, SHORT_HEADER = r"^(?:\$ |\[exit|\[killed|\[job)", r"^(?:\$ |\[exit|\[killed)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: array functions don't share what their lambdas repeat."""
    return F.transform(F.array(value), use)[0]


def exploded(df: DataFrame, array: Column | str, *names: str) -> DataFrame:
    """A row for every element of an array, with its place if there are two names. Rows without elements go
    after the explosion: the plain one asks for a size first, and that filter is evaluated below, with all that
    gives the array written out in it."""
    made = (F.posexplode_outer if len(names) > 1 else F.explode_outer)(array)
    return df.select("*", made.alias(*names)).where(F.col(names[0]).isNotNull())


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def header_size(lines: Column, prefix: str = HEADER) -> Column:
    """Leading lines that a tool puts before its output, or that are empty."""
    other = F.array_position(F.transform(lines, lambda x: ~(x.rlike(prefix) | (x == ""))), True)
    return F.when(other == 0, F.size(lines)).otherwise(other - 1).cast("int")


def first_of(lines: Column, n: Column | int) -> Column:
    return F.slice(lines, F.lit(1), F.greatest(F.lit(0), F.lit(n) if isinstance(n, int) else n))


def after(lines: Column, n: Column) -> Column:
    return F.slice(lines, n + 1, F.greatest(F.lit(0), F.size(lines) - n))


def last_of(lines: Column, n: Column | int) -> Column:
    """The last n lines (none for 0)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.greatest(F.lit(0), n))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\A\s+|\s+\z", "")


def islands(items: Column, differ: Callable[[Column, Column], Column]) -> Column:
    """Runs of neighbours that don't differ, as arrays in order. Linear in the items, which must be a column
    or bound by `let`."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: F.when(i == 0, True).otherwise(differ(F.get(items, i - 1), F.get(items, i))))
    return let(starts, lambda s: F.transform(s, lambda a, k: F.slice(items, a + 1, F.coalesce(F.get(s, k + 1), F.size(items)) - a)))


def is_blank(line: Column) -> Column:
    return line.rlike(r"(?U)\A\s*\z")


def collapse_blank(lines: Column, keep: int = 1) -> Column:
    """At most `keep` blank lines in a row."""
    return F.filter(lines, lambda x, i: ~is_blank(x) | (i < keep) | F.exists(F.slice(lines, F.greatest(F.lit(1), i - keep + 1), F.lit(keep)), lambda y: ~is_blank(y)))


def collapse_runs(lines: Column, most: int) -> Column:
    """At most `most` equal lines in a row, then a note of how many more there were. `lines` must be a
    column or bound by `let`."""
    if most <= 0:
        return lines
    note = lambda r: F.concat(F.lit("[... "), (F.size(r) - most).cast("string"), F.lit(" repeated lines omitted ...]"))
    thinned = lambda r: F.when(F.size(r) > most, F.concat(F.slice(r, 1, most), F.array(note(r)))).otherwise(r)
    return F.flatten(F.transform(islands(lines, lambda x, y: x != y), thinned))


def window(lines: Column, head: Column | int, tail: Column | int, noun: str = "lines") -> Column:
    """First and last lines with a note between, if there are more than both."""
    n, both = F.size(lines), F.lit(head) + F.lit(tail)
    note = F.concat(F.lit("[... "), (n - both).cast("string"), F.lit(f" {noun} omitted ...]"))
    return F.when(n > both, F.concat(first_of(lines, head), F.array(F.lit(""), note, F.lit("")), last_of(lines, tail))).otherwise(lines)
