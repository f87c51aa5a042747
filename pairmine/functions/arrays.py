"""Token-id arrays: truncation, padding, masks, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "right")


def _check_side(side: str) -> None:
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}, got {side!r}")


def _fill(value: int, count: Column | int, like: str) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.array_repeat(F.lit(value).cast(like), count)


def pad_array(
    values: Column, length: Column | int, pad: int, side: str = "right", element: str = "bigint"
) -> Column:
    """Pad to ``length`` (arrays already as long are left alone)."""
    _check_side(side)
    target = F.lit(length) if isinstance(length, int) else length
    padding = _fill(pad, F.greatest(target - F.size(values), F.lit(0)), element)
    return F.concat(padding, values) if side == "left" else F.concat(values, padding)


def fixed_length_ids(ids: Column, length: int, pad_id: int, side: str = "left") -> Column:
    """The first ``length`` ids, padded to exactly ``length``."""
    return pad_array(F.slice(ids, 1, length), length, pad_id, side)


def fixed_length_mask(ids: Column, length: int, side: str = "left") -> Column:
    """1 for each kept id, 0 for each padding position."""
    kept = _fill(1, F.least(F.size(ids), F.lit(length)), "int")
    return pad_array(kept, length, 0, side, "int")


def prompt_length(ids: Column, mask: Column, pad_id: int, side: str = "left") -> Column:
    """Length without padding.

    Right side: the number of mask ones. Left side: the number of ids that differ from the pad
    id, which is smaller when the pad id also occurs inside the text.
    """
    _check_side(side)
    if side == "right":
        return F.aggregate(mask, F.lit(0), lambda total, bit: total + bit)
    return F.size(F.array_remove(ids, pad_id))
