"""Column expressions on names, paths, units and attempts of process specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How strongly a kind of dependency binds; of several edges to one producer the strongest stays.
PRIORITY = {"none": 0, "aftercorr": 1, "after": 2, "afterany": 3, "afterok": 4, "afternotok": 4}
#: Megabytes in a unit, as numerator and denominator.
UNITS = {"K": (1, 1024), "M": (1, 1), "G": (1024, 1), "T": (1024 * 1024, 1)}


def memory_mb(value: Column) -> Column:
    """A memory size such as 512, 900K or 4G in whole megabytes; null if it is none."""
    number = F.regexp_extract(value, r"^([0-9]+)[KMGT]?$", 1)
    unit = F.regexp_extract(value, r"^[0-9]+([KMGT]?)$", 1)
    n = F.when(number != "", number.cast("long"))
    out = F.when(unit == "", n)
    for name, (times, per) in UNITS.items():
        out = out.when(unit == name, F.floor(n * times / per).cast("long"))
    return out


def elapsed_text(micros: Column) -> Column:
    """Seconds and milliseconds, as in 12.034."""
    return F.concat(F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad(F.floor(F.pmod(micros, F.lit(1_000_000)) / 1000).cast("string"), 3, "0"))


def normal_path(path: Column) -> Column:
    """A path with single slashes and none at its end."""
    squeezed = F.regexp_replace(path, "/+", "/")
    return F.when(squeezed == "/", squeezed).otherwise(F.regexp_replace(squeezed, "/$", ""))


def is_name(name: Column) -> Column:
    """Whether a name of a process is well formed."""
    return F.rlike(name, F.lit("^[a-zA-Z_][a-zA-Z_0-9]*(::[a-zA-Z_][a-zA-Z_0-9]*)*$"))


def is_output(option: Column) -> Column:
    return option.startswith("-out") | option.startswith("--out")


def is_absolute(value: Column) -> Column:
    return value.startswith("/")


def attempt(values: Column, number: int) -> Column:
    """The value for an attempt (from 1) of a comma-separated list; later attempts use the last."""
    parts = F.split(values, ",", -1)
    return F.element_at(parts, F.least(F.lit(number), F.size(parts)))


def attempts(*lists: Column) -> Column:
    """How many attempts a process has: the longest of its comma-separated lists."""
    sizes = [F.size(F.split(x, ",", -1)) for x in lists]
    return F.greatest(*sizes) if len(sizes) > 1 else sizes[0]


def attributes(text: Column) -> Column:
    """A map of the k=v attributes of a specification, separated by semicolons."""
    return F.str_to_map(F.regexp_replace(text, r"\s*;\s*", ";"), F.lit(";"), F.lit("="))


def version_number(version: Column) -> Column:
    """A dotted version as one number to compare by."""
    return F.aggregate(F.transform(F.split(version, r"\.", -1), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a * 1000 + x)


def fixed_width(value: Column, width: int) -> Column:
    """Padded on the left, cut on the right."""
    return F.lpad(value.cast("string"), width, " ")
