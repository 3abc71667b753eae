"""Scalar functions as Column expressions, and their fixed tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: type codes of the dump format, in order
TYPE_NAMES = {2: "object", 4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}
TYPE_SIZES = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
ARRAY_LETTERS = {4: "Z", 5: "C", 6: "F", 7: "D", 8: "B", 9: "S", 10: "I", 11: "J"}
# fixed values: root types of the dump format and how notes name them, in order
ROOT_TYPES = {
    1: "JNI global", 2: "JNI local", 3: "Java frame", 4: "native stack", 5: "sticky class", 6: "thread block", 7: "monitor used", 8: "thread object",
}
#: Lengths of the two ends of a long text on display, and the length up to which it is shown whole.
SHOWN_END, SHOWN_WHOLE = 20, 50


def shallow_size(raw: Column) -> Column:
    """Sizes are kept in units of 8 bytes, in 31 bits."""
    return F.least(F.shiftrightunsigned(raw, 3), F.lit(2147483647).cast("long")) * 8


def dotted(name: str) -> str:
    return name.replace("/", ".")


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a pattern in which only * is special; slashes are dots."""
    return "^" + ".*".join(re.escape(p) for p in dotted(pattern).split("*")) + "$"


def shown(text: Column) -> Column:
    """Long texts are shown by both ends."""
    both = F.concat(F.left(text, F.lit(SHOWN_END)), F.lit("..."), F.right(text, F.lit(SHOWN_END)))
    return F.when(F.length(text) > SHOWN_WHOLE, both).otherwise(text)


def root_label(code: Column) -> Column:
    out = F.lit("GC root")
    for number, label in ROOT_TYPES.items():
        out = F.when(code == number, f"GC root ({label})").otherwise(out)
    return out


def compare(value: Column, op: str, other: Column) -> Column:
    return {">": value > other, ">=": value >= other, "<": value < other, "<=": value <= other, "=": value == other}[op]


def text_matches(value: Column, kind: str, text: str) -> Column:
    """kind: equals, prefix, suffix, contains; the text is literal."""
    other = F.lit(text)
    return {"equals": value == other, "prefix": F.startswith(value, other), "suffix": F.endswith(value, other), "contains": F.contains(value, other)}[kind]


def primitive_text(type_code: Column, long_val: Column, double_val: Column) -> Column:
    """A primitive value for display."""
    return (
        F.when(type_code == 4, F.when(long_val != 0, "true").otherwise("false")).when(type_code == 5, F.char(long_val))
        .when(type_code.isin(6, 7), double_val.cast("string")).otherwise(long_val.cast("string"))
    )


def type_name(type_code: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, name in TYPE_NAMES.items():
        out = F.when(type_code == number, name).otherwise(out)
    return out


def decoded(data: Column, elem_type: Column) -> Column:
    """Text of a payload: char[] as UTF-16, byte[] as UTF-8."""
    return F.when(elem_type == 5, F.decode(data, "UTF-16BE")).when(elem_type == 8, F.decode(data, "UTF-8"))
