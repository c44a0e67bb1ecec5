"""Column expressions on strings, paths, serialised arguments, ranges and predicates of option values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing option, an option without a value, and no file.
NOT_FOUND, VOID, NO_FILE = "_OPT_NOT_FOUND_", "_VOID_VALUE_", "_NONE_"
#: What separates serialised arguments, and the name and index of a task.
ARG_SEP, ELEM_SEP, TASK_SEP = "<_ARG_SEP_>", "__ELEMSEP__", "|||"
#: How references to values, and to outputs of processes, begin.
VALUE_MARK, OUTPUT_MARK = ".__VAL_DESCRIPTOR__", "__PROC_OUT_OPT_DESCRIPTOR__"
#: Fixed value: the end of a stream.
END = "__SHUTDOWN_TOKEN__"


def trimmed(value: Column) -> Column:
    """Without the white space at its ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def quotes_escaped(value: Column) -> Column:
    return F.replace(value, F.lit('"'), F.lit('\\"'))


def swapped(value: Column, old: str, new: str) -> Column:
    """Each blank by a word, or each word by a blank."""
    return F.replace(value, F.lit(old), F.lit(new))


def fields(value: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(value, r"\s+", -1), lambda x: x != "")


def first_fields(value: Column, n: int) -> Column:
    """The first n fields, blank-joined."""
    return F.array_join(F.slice(fields(value), 1, n), " ") if n else F.lit("")


def serialised(args: Column, sep: str = ARG_SEP, most: int | None = None) -> Column:
    """Arguments as one string; beyond `most` three dots stand for the rest."""
    if most is None:
        return F.array_join(args, sep)
    return F.array_join(F.when(F.size(args) > most, F.concat(F.slice(args, 1, most), F.array(F.lit("...")))).otherwise(args), sep)


def deserialised(text: Column, sep: str = ARG_SEP) -> Column:
    """The arguments of a serialised string; an empty one has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\\Q" + sep + "\\E", -1))


def absolute(path: Column, folder: Column) -> Column:
    """The path from the root, without empty, `.` and `..` parts."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.filter(F.split(whole, "/", -1), lambda x: (x != "") & (x != "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def home_expanded(path: Column, home: str) -> Column:
    """A leading ~ as the home folder."""
    return F.regexp_replace(path, r"^~(?=/|$)", home)


def owned_name(path: Column) -> Column:
    """The last two parts of a path: whose stream it is, and its name."""
    return F.substring_index(path, "/", -2)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_option(value: Column) -> Column:
    return value.startswith("-")


def is_natural(value: Column) -> Column:
    return F.rlike(value, F.lit("^[0-9]+$"))


def is_output_reference(value: Column) -> Column:
    """Whether a value stands for an output of a process."""
    return value.startswith(OUTPUT_MARK)


def is_value_reference(value: Column) -> Column:
    """Whether a value is the path of a passed value."""
    return value.startswith("/") & base_name(value).startswith(VALUE_MARK)


def is_list_name(name: Column) -> Column:
    """Whether a name is that of a list of options."""
    return name.endswith("optlist")


def argument(args: Column, option: str) -> Column:
    """The value after an option among arguments; VOID if an option or nothing follows, NOT_FOUND without the option."""
    at = F.array_position(args, F.lit(option)).cast("int")
    after = F.get(args, at)
    return F.when(at == 0, NOT_FOUND).when(after.isNull() | is_option(after), VOID).otherwise(after)


def task_range(element: Column) -> Column:
    """The indices of `a-b`, or of `a` alone; of anything else none."""
    low, high = (F.regexp_extract(element, "^([0-9]+)(?:-([0-9]+))?$", k) for k in (1, 2))
    start = low.try_cast("long")
    end = F.when(high != "", high.try_cast("long")).otherwise(start)
    return F.when(start.isNotNull() & (start <= end), F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))


def chance(key: Column, percent: int) -> Column:
    """True for about so many of a hundred keys, always the same ones."""
    digest = F.md5(key.cast("string"))
    letter = lambda k: F.ascii(F.substring(digest, k, 1))
    return F.pmod(letter(1) * 31 + letter(2) * 17 + letter(3) * 7 + letter(4), F.lit(100)) < percent


def block_index(path: Column) -> Column:
    """The number of a block's file, as in blk12.txt; null for other files."""
    found = F.regexp_extract(base_name(path), r"blk(\d+)\.txt$", 1)
    return found.try_cast("long")


def dependency_type(dependency: Column) -> Column:
    return F.split_part(dependency, F.lit(":"), F.lit(1))


def dependency_producer(dependency: Column) -> Column:
    return F.split_part(dependency, F.lit(":"), F.lit(2))
