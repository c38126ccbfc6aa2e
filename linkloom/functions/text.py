"""Text columns: word sets, similarity, slugs, percent-decoding, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases of pages that say they are out of date, in order.
STALE = ("this page is deprecated", "this page has been archived", "this documentation is archived", "has been superseded")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The distinct words of A-Z, a-z and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def word_hashes(c: Column) -> Column:
    """The words' 64-bit hashes, in order: as good as the words for similarity, and shorter."""
    return F.array_sort(F.transform(words(c), lambda w: F.xxhash64(w)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets, of words or their hashes; 0 if either has under three words."""
    both = F.size(F.array_intersect(a, b))
    value = both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) < 3) | (F.size(b) < 3), 0.0).otherwise(value)


def two_digits(c: Column) -> Column:
    return F.format_number(c, 2)


def staleness(body: Column) -> Column:
    """The first phrase of STALE in the text."""
    low = ascii_lower(body)
    return F.coalesce(*(F.when(F.contains(low, F.lit(p)), p) for p in STALE))


def slug(c: Column) -> Column:
    """Heading anchor: lower case, blanks to hyphens, only letters, digits, - and _."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def numbered(slugs) -> list[str]:
    taken: set[str] = set()
    out = []
    for s in slugs if slugs is not None else ():
        name, n = s, 0
        while name in taken:
            n += 1
            name = f"{s}-{n}"
        taken.add(name)
        out.append(name)
    return out


def percent_decoded(c: Column) -> Column:
    """struct(value, error): strict decoding; + stays; error (fixed texts) says what is wrong with the first escape that is."""
    odd = F.regexp_extract(c, "(?s)(%(?![0-9A-Fa-f]{2}).*)$", 1)
    digits = F.array_join(F.transform(F.split(c, "%"), lambda part, i: F.when(i == 0, F.hex(part)).otherwise(F.concat(F.substring(part, F.lit(1), F.lit(2)), F.hex(F.substring(part, F.lit(3), F.length(part)))))), "")
    value = F.when(~F.contains(c, F.lit("%")), c).when(odd == "", F.try_validate_utf8(F.unhex(digits).cast("string")))
    error = F.when(odd != "", F.when(F.octet_length(odd) < 3, "incomplete escape").otherwise("non-hexadecimal escape")).when(c.isNotNull() & value.isNull(), "invalid UTF-8")
    return F.struct(value.alias("value"), error.alias("error"))
