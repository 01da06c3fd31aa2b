"""Column functions on text: normalising, tokenising, keys, numbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return strip(F.regexp_replace(c, SPACE, " "))


def normalize(c: Column) -> Column:
    """Every digit between blanks, then squeezed."""
    return squeeze(F.regexp_replace(c, r"(\p{Nd})", " $1 "))


def tokens(c: Column) -> Column:
    """Lower-case words without punctuation, of two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda x: F.length(x) >= 2)


def tokens_raw(c: Column) -> Column:
    """Lower-case words as white space divides them, of two characters or more."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: F.length(x) >= 2)


def chunk_id(doc: Column, i: Column) -> Column:
    return F.format_string("%s_chunk_%02d", doc.cast("string"), i)


def query_hash(c: Column) -> Column:
    return F.substring(F.sha2(squeeze(F.lower(c)).cast("binary"), 256), 1, 16)


def doc_key(c: Column) -> Column:
    return F.when(c == "", "").otherwise(F.md5(squeeze(c).cast("binary")))


def numbered(docs: Column) -> Column:
    """"[1] first", "[2] second", joined by blank lines."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n\n")


#: What stands between the documents of a context.
BETWEEN = "\n\n"


def join_context(docs: Column) -> Column:
    return F.array_join(docs, BETWEEN)


def split_context(context: Column) -> Column:
    """The documents of a joined context; an empty one has none. A document that holds a blank line comes back in parts."""
    return F.when(F.coalesce(context, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(context, BETWEEN))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def with_context(context: Column, chunk: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), chunk)).otherwise(chunk)


def l2_normalize(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
