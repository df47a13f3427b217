"""Path expressions. A path is relative, with "/" between its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def folded(c: Column) -> Column:
    """Lower case letter by letter: without this, a final sigma and a dotted I would depend on their surroundings."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def parts(rel: Column) -> Column:
    return F.split(rel, "/")


def name(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def parent(rel: Column) -> Column:
    """The directory of a path, "" at the root."""
    return F.when(F.instr(rel, "/") == 0, F.lit("")).otherwise(F.regexp_replace(rel, "/[^/]*$", ""))


def rel_dir(rel: Column) -> Column:
    """As parent, but "" for what leaves the tree."""
    p = parent(rel)
    return F.when((p == "..") | p.startswith("../"), F.lit("")).otherwise(p)


def ancestors(rel: Column) -> Column:
    """All directories above a path, the outermost first."""
    p = parts(rel)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def last_dot_ext(path: Column) -> Column:
    """From the last dot of the last part on, with the dot; "" without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def extension(file_name: Column) -> Column:
    """Folder extension of a name: one leading dot doesn't count; compound archive suffixes stay whole; lower case; "" if there is none or it would leave its folder."""
    stem = F.regexp_replace(file_name, r"^\.", "")
    low = folded(stem)
    compound = F.regexp_extract(low, r"\.(" + "|".join(c.replace(".", r"\.") for c in dims.COMPOUND) + ")$", 1)
    ext = F.when(F.instr(stem, ".") == 0, F.lit("")).when(compound != "", compound).otherwise(F.substring_index(low, ".", -1))
    return F.when(F.contains(ext, F.lit("/")) | F.contains(ext, F.lit("..")), F.lit("")).otherwise(ext)


def ext_folder(ext: Column) -> Column:
    return F.when(ext == "", F.lit(dims.NO_EXTENSION)).otherwise(ext)


def flat_name(rel: Column) -> Column:
    """A file at the root keeps its name; any other gets the name of its own directory before it."""
    p = parts(rel)
    return F.when(F.size(p) == 1, rel).otherwise(F.concat_ws("_", F.element_at(p, -2), F.element_at(p, -1)))


def title(file_name: Column) -> Column:
    """The name without its last extension, with blanks for _ and -."""
    return F.trim(F.translate(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_-", "  "))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two cleaned absolute paths are equal or one holds the other, upper and lower case alike."""
    x, y = (F.filter(parts(folded(c)), lambda p: p != "") for c in (a, b))
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n)


def truncate_middle(s: Column, most: int) -> Column:
    """At most `most` characters: the middle gives way to one ellipsis. Under five nothing is cut."""
    if most < 5:
        return s
    head = (most - 1) // 2
    tail = most - 1 - head
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, head), F.lit("…"), F.substr(s, F.char_length(s) - (tail - 1))))
