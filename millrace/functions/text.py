"""Scalar text functions as Column expressions; nothing here leaves the JVM.

Word characters and white space are written as explicit classes, because Java's and SQL engines'
shorthands are ASCII while the texts aren't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the body of a character class.
SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]+"
PREFIX = "Subject:"
LABELS = ("legitimate", "spam")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none is left at either end."""
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def normalize(c: Column) -> Column:
    """Lower case, spaces around each character that is neither of a word nor white space."""
    return squeeze(F.regexp_replace(F.lower(c), rf"([^\p{{L}}\p{{N}}_{SPACES}])", " $1 "))


def format_message(subject: Column, body: Column) -> Column:
    return F.concat(F.lit(f"{PREFIX} "), normalize(F.concat(subject, F.lit(" "), body)))


def without_prefix(c: Column, prefix: str = PREFIX) -> Column:
    """The literal prefix taken off once, case-sensitively."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 2_147_483_647)).otherwise(c)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def clean_body(c: Column) -> Column:
    """CRLF becomes LF, white space at both ends goes."""
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), f"^[{SPACES}]+|[{SPACES}]+$", "")


def preview(c: Column, width: int = 90) -> Column:
    bare = without_prefix(c, f"{PREFIX} ")
    return F.concat(F.substring(bare, 1, width), F.when(F.length(bare) > width, F.lit("...")).otherwise(F.lit("")))


def swap_words(c: Column, table: dict[str, str]) -> Column:
    """Whole-word substitution in one pass, so a replacement is never replaced again."""
    pieces = F.regexp_extract_all(c, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(lookup, w), w)), "")


def has_word(c: Column, table: dict[str, str]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.array(*map(F.lit, table)))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def tag_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: squeeze(x)), lambda x: x != "")


def label_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), code + 1)


def label_code(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, LABELS)), name)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), name)).cast("int"))
