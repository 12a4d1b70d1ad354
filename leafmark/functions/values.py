"""Small functions of values as expressions: keys, points, names, geometry, colours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def verse_key(key: Column) -> Column:
    """"7:82" as numbers that sort; anything else as [0]."""
    parts = F.transform(F.split(key, ":"), lambda p: F.trim(p).try_cast("bigint"))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts).otherwise(F.array(F.lit(0).cast("bigint")))


def point(value: Column, chapter: Column) -> Column:
    """chapter:verse, or a verse alone in a chapter given; null where neither fits."""
    both, alone = F.regexp_extract(value, r"^\s*(\d+):(\d+)\s*$", 1), F.regexp_extract(value, r"^\s*(\d+)\s*$", 1)
    verse = F.regexp_extract(value, r"^\s*(\d+):(\d+)\s*$", 2)
    pair = F.struct(both.try_cast("bigint").alias("chapter"), verse.try_cast("bigint").alias("verse"))
    return F.when(both != "", pair).when((alone != "") & chapter.isNotNull(), F.struct(chapter.cast("bigint").alias("chapter"), alone.try_cast("bigint").alias("verse")))


def span(value: Column) -> Column:
    """from-to, each a point; the second may leave its chapter out."""
    a = point(F.split_part(value, F.lit("-"), F.lit(1)), F.lit(None).cast("bigint"))
    return F.struct(a.alias("start"), point(F.split_part(value, F.lit("-"), F.lit(2)), a["chapter"]).alias("end"))


def safe_stem(name: Column, default: str) -> Column:
    """A name of letters, digits, - and _ only, without - at its ends."""
    stem = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit(default))


def public_name(display: Column, mail: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), F.split_part(mail, F.lit("@"), F.lit(1)))


def geometry(w: Column, h: Column, area: Column, peak_offset: Column, band: Column) -> Column:
    """Six features of a component's shape, each bounded: r / (1 + r) of its sizes against the band's height."""
    return F.array(w / (band + w), h / (band + h), area / (band * band + area), area / (w * h), w / (w + h), peak_offset / (band + F.abs(peak_offset)))


def colour(label: Column) -> Column:
    """A component's number as red, green and blue."""
    return F.struct(label.bitwiseAND(255).alias("r"), F.shiftright(label, 8).bitwiseAND(255).alias("g"), F.shiftright(label, 16).bitwiseAND(255).alias("b"))


def label_of(rgb: Column) -> Column:
    return rgb["r"] + F.shiftleft(rgb["g"], 8) + F.shiftleft(rgb["b"], 16)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once for a row, however often it is used, also inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
