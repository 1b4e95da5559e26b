"""Column functions on names and texts; everything here runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` only knows the space character)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot; ``''`` for none. Leading dots belong to the stem."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def capitalize(text: Column) -> Column:
    """First letter up, the rest down."""
    rest = F.substring(text, F.lit(2), F.length(text))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(rest))


def join_present(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty; ``''`` when none is left."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def glob_to_regex(pattern: str) -> str:
    """Shell glob as a Java regular expression over a whole name.

    Ends in ``\\z``: Java's ``\\Z`` would also match before a final newline.
    """
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            # A "]" directly after the bracket (or its "!") is a member, not the end.
            start = i + 1 if pattern[i:i + 1] == "!" else i
            end = pattern.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
                continue
            members = "".join(c if c.isalnum() or c == "-" else "\\" + c for c in pattern[start:end])
            out.append(f"[{'^' if start > i else ''}{members}]")
            i = end + 1
        else:
            out.append(char if char.isalnum() else "\\" + char)
    return f"(?s)\\A{''.join(out)}\\z"
