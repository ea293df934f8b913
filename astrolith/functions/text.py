"""Column expressions over source text: lines, tags, hashes, dependency names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line: the usual ends, and file, group and record separators.
LINE_END = r"\R|[\x1C-\x1E]"
TODO = r"(?i)#\s*(TODO|FIXME|HACK|XXX)\b[:\s]*(.*)"


def lines(text: Column) -> Column:
    """Lines of a text; an end of line at its end opens no further one. Null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, LINE_END)
    return F.when(t == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def loc(text: Column) -> Column:
    return F.size(lines(text)).cast("bigint")


def sloc(text: Column) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(lines(text), lambda x: x.rlike(r"(?U)\S"))).cast("bigint")


def todo_tag(line: Column) -> Column:
    return F.upper(F.regexp_extract(line, TODO, 1))


def todo_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, TODO, 2))


def dep_name(requirement: Column) -> Column:
    """Name of a requirement: what stands before a version, extra, marker or address; lower case, with - for _ and the dot."""
    return F.lower(F.translate(F.regexp_extract(F.trim(requirement), r"^([^>=<!~\[\];, @]*)", 1), "_.", "--"))


def content_key(content: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def content_sha1(content: Column) -> Column:
    return F.sha1(content)


def is_binary(content: Column) -> Column:
    """Whether the first 8 KB hold a NUL byte, or the first 1,024 bytes are no UTF-8 up to a sign that they cut."""
    head = [F.is_valid_utf8(F.substring(content, 1, 1024 - k)) for k in range(4)]
    return F.substring(content, 1, 8192).cast("string").contains("\x00") | ~(head[0] | ((F.octet_length(content) > 1024) & (head[1] | head[2] | head[3])))


def encoding(content: Column) -> Column:
    """A guess at how bytes are encoded: by a byte order mark, as UTF-8 if they are valid, else ISO-8859-1. Null for binary content without a mark."""
    begins = lambda mark: F.hex(F.substring(content, 1, len(mark) // 2)) == mark
    return F.when(begins("EFBBBF"), "UTF-8").when(begins("FFFE") | begins("FEFF"), "UTF-16").when(F.substring(content, 1, 8192).cast("string").contains("\x00"), None).when(F.is_valid_utf8(content), "UTF-8").otherwise("ISO-8859-1")


def long_line_ratio(text: Column) -> Column:
    """Signs a line, on average."""
    return F.length(text) / F.greatest(loc(text), F.lit(1))


def looks_generated(text: Column) -> Column:
    """Whether a text says so in its first ten lines, or has lines of over 110 signs on average, as minified code does."""
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n"))
    return head.rlike("generated by|do not edit|autogenerated|auto-generated|automatically generated") | (long_line_ratio(text) > 110)


def body(content: Column, s_byte: Column, e_byte: Column) -> Column:
    """Bytes s_byte up to e_byte of binary content, as text."""
    return F.decode(F.substring(content, (s_byte + 1).cast("int"), (e_byte - s_byte).cast("int")), "UTF-8")


def window(text: Column, offset: int, limit: int | None) -> Column:
    """limit lines of a text from line offset on, counted from 0."""
    parts = F.split(text, "\n")
    return F.array_join(F.slice(parts, offset + 1, F.lit(limit) if limit is not None else F.greatest(F.size(parts) - offset, F.lit(0))), "\n")


def dedent(text: Column) -> Column:
    """A text without the white space that all its non-blank lines begin with."""
    parts = F.split(text, "\n")
    widths = F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    cut = F.coalesce(F.array_min(widths), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substr(x, cut + 1))), "\n")


def reindent(text: Column, indent: Column) -> Column:
    """A dedented text with indent before each non-blank line and one end of line at its end."""
    parts = F.split(F.rtrim(F.regexp_replace(dedent(text), r"\n+$", "")), "\n")
    return F.concat(F.array_join(F.transform(parts, lambda x: F.when(x == "", "").otherwise(F.concat(indent, x))), "\n"), F.lit("\n"))
