"""Small text functions: placeholders, flags, formatting with a fallback, ranges and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of a detector command, and the columns or settings that fill them.
PLACEHOLDERS = ("source", "model", "device", "imgsz", "conf", "iou", "frame_id", "tile_id", "x1", "y1", "x2", "y2")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Every {name} of PLACEHOLDERS replaced by its value."""
    return reduce(lambda t, n: F.replace(t, F.lit("{" + n + "}"), values[n].cast("string")) if n in values else t, PLACEHOLDERS, template)


def flag(text: Column) -> Column:
    """1, true, TRUE and yes are true; all else, null too, is false."""
    return F.coalesce(text.isin("1", "true", "TRUE", "yes"), F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """A number text with ``digits`` decimals; text that is no number stays as it is."""
    number = value.try_cast("double")
    return F.when(number.isNull(), value).otherwise(F.format_string(f"%.{digits}f", number))


def short_host(host: Column) -> Column:
    """The part of a host name before its first dot."""
    return F.substring_index(host, ".", 1)


def split_start(total: Column, parts: Column, index: Column) -> Column:
    """Start of part ``index`` of ``total`` dealt into ``parts`` even ranges, longer ones first."""
    return index * F.floor(total / parts) + F.least(index, total % parts)


def split_end(total: Column, parts: Column, index: Column) -> Column:
    """End of that part."""
    return split_start(total, parts, index + 1)


def split_index(total: int, parts: int, k: Column) -> Column:
    """The part that number k of 0..total-1 is in."""
    size, longer = total // parts, total % parts
    return F.when(k < longer * (size + 1), F.floor(k / (size + 1))).otherwise(longer + F.floor((k - longer * (size + 1)) / max(size, 1))).cast("int")



def most_square_rows(processes: Column) -> Column:
    """Rows of the most square grid with no more rows than columns; only numbers up to the square root are tried."""
    root = F.greatest(F.lit(1), F.floor(F.sqrt(processes))).cast("bigint")
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("bigint"), root), lambda d: (processes % d == 0) & (d * d <= processes)))
