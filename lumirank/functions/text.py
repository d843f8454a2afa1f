"""Token and sequence expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

JSON_STRINGS = "array<string>"


def tokens(col: Column, splitter: str = "^", lower: bool = False) -> Column:
    """Split on a literal separator, keeping empty tokens."""
    out = F.split(col, re.escape(splitter), -1)
    return F.transform(out, F.lower) if lower else out


def join_tokens(col: Column, splitter: str = "^") -> Column:
    return F.array_join(col.cast("array<string>"), splitter)


def pad(arr: Column, max_len: int, value=0, padding: str = "pre", truncating: str | None = None) -> Column:
    """Fixed-width array. `pre` truncation keeps the tail, `post` keeps the head."""
    truncating = truncating or padding
    for side in (padding, truncating):
        if side not in ("pre", "post"):
            raise ValueError(f"Unsupported padding: {side}")
    if truncating == "pre":
        start = F.greatest(F.size(arr) - max_len + 1, F.lit(1))
        kept = F.slice(arr, start, F.lit(max_len))
    else:
        kept = F.slice(arr, 1, max_len)
    kept = F.coalesce(kept, F.array().cast("array<int>"))
    fill = F.array_repeat(F.lit(value), F.lit(max_len) - F.size(kept))
    return F.concat(fill, kept) if padding == "pre" else F.concat(kept, fill)


def truncate(arr: Column, max_len: int, side: str) -> Column:
    """The tokens that survive in a fixed-width encoding of that side."""
    if side == "pre":
        return F.slice(arr, F.greatest(F.size(arr) - max_len + 1, F.lit(1)), F.lit(max_len))
    return F.slice(arr, 1, max_len)


def effective_length(arr: Column, pad_token: str = "0") -> Column:
    """1-based place of the last token other than the padding token."""
    places = F.transform(arr, lambda x, i: F.when(F.trim(x) != pad_token, i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0)).cast("int")


def fixed_width_ints(arr: Column, max_len: int, padding: str = "post", value: int = 0) -> Column:
    """Null and NaN entries become the padding value, then the array gets a fixed width."""
    clean = F.transform(arr, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(value))
                        .otherwise(x).cast("long"))
    return pad(F.coalesce(clean, F.array().cast("array<bigint>")), max_len, F.lit(value).cast("long"), padding)


def normalize_id(col: Column) -> Column:
    """Ids as comparable text: trimmed, and `5.0` read as `5`."""
    return F.regexp_replace(F.trim(col.cast("string")), r"^(-?\d+)\.0+$", "$1")


def parse_sequence(col: Column) -> Column:
    """Values of a JSON list or of comma/semicolon/space separated text, as distinct ids."""
    text = F.trim(col)
    as_json = F.from_json(text, JSON_STRINGS)
    loose = F.split(F.regexp_replace(text, r"^\[+|\]+$", ""), r"[,;\s]+")
    values = F.when(text.startswith("[") & text.endswith("]"), F.coalesce(as_json, loose)).otherwise(
        F.split(text, r"[,;\s]+"))
    ids = F.transform(values, normalize_id)
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))


def content_key(col: Column) -> Column:
    """128-bit digest of a text, or of an array's values; null stays null. Stands for long values in shuffles."""
    return F.unhex(F.md5(col))


def array_key(arr: Column) -> Column:
    return content_key(F.array_join(arr.cast("array<string>"), ",", "~"))


def slug(col: Column) -> Column:
    return F.regexp_replace(col, r"[^A-Za-z0-9_.-]+", "_")


def append_capped(values: Column, cap: int = 31) -> Column:
    """A multi-value list that stops growing past its cap."""
    return F.slice(values, 1, cap)
