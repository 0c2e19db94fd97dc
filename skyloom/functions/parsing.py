"""Small grammars that the operators' parameters use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(text: Column, path: str) -> Column:
    """The value at a path such as ``$.a.b[0]`` of a JSON text, as a string; null where it is missing
    or null. Objects and lists come as JSON."""
    return F.get_json_object(text, path)


def parse_select_list(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges of ``a:b,c,d:e``; raises ValueError on anything else."""
    out = []
    for part in text.split(","):
        low, _, high = part.partition(":")
        a, b = int(low), int(high or low)
        if a > b:
            raise ValueError(f"range {part!r} is empty")
        out.append((a, b))
    return sorted(out)


def renumber(k: Column, ranges: list[tuple[int, int]]) -> Column:
    """The place of plane ``k`` among the selected ones, from 0; null where it isn't selected."""
    place, before = F.lit(None).cast("long"), 0
    for a, b in ranges:
        place = F.when(k.between(a, b), (k - a + before).cast("long")).otherwise(place)
        before += b - a + 1
    return place
