"""Read haplotype tags: h (1 or 2; 0 unphased), p (phase block), r (start in the read), l (length)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNPHASED = "h0,p0,r0,l0"
ENTRY = r"^h([0-9]+),p([0-9]+),r([0-9]+),l([0-9]+)$"


def encode(tags: Column) -> Column:
    """array<struct<h,p,r,l>> as text; no entry or null is the unphased tag."""
    text = F.array_join(F.transform(tags, lambda t: F.format_string("h%d,p%d,r%d,l%d", t["h"], t["p"], t["r"], t["l"])), ";")
    return F.when(tags.isNull() | (F.size(tags) == 0), UNPHASED).otherwise(text)


def entry(text: Column) -> Column:
    """One entry as struct<h,p,r,l>; fields are null where the text is malformed."""
    field = lambda i: F.when(text.rlike(ENTRY), F.regexp_extract(text, ENTRY, i)).cast("long")
    return F.struct(field(1).alias("h"), field(2).alias("p"), field(3).alias("r"), field(4).alias("l"))


def decode(text: Column) -> Column:
    return F.transform(F.split(text, ";"), lambda t: entry(t))


def swapped(tags: Column, block: Column | None = None) -> Column:
    """Haplotypes 1 and 2 exchanged, in one block or in all; unphased entries stay."""

    def one(t: Column) -> Column:
        mine = t["h"].isin(1, 2) if block is None else t["h"].isin(1, 2) & (t["p"] == block)
        return F.struct(F.when(mine, 3 - t["h"]).otherwise(t["h"]).alias("h"), t["p"].alias("p"), t["r"].alias("r"), t["l"].alias("l"))

    return F.transform(tags, one)


def chunk_of(tag: Column) -> Column:
    """idx, start and end of a chunk tag `idx,start-end`."""
    part = lambda i: F.regexp_extract(tag, r"^([0-9]+),([0-9]+)-([0-9]+)$", i).cast("long")
    return F.struct(part(1).alias("idx"), part(2).alias("start"), part(3).alias("end"))
