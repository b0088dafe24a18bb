"""String functions: first-match replacement, prefix views and 32-bucket fingerprints."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def regexp_replace_first(text: Column, pattern: str, replacement: str) -> Column:
    r"""The text with the first match of *pattern* replaced; groups are ``\1`` to ``\9``, and *pattern* has no more than eight."""
    groups = re.compile(pattern).groups
    tail = f"${groups + 2}"
    java = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", replacement.replace("$", "\\$"))
    # A lazy head and the rest of the text around one match leave nothing for a second.
    anchored = pattern.startswith("^")
    return F.regexp_replace(text, f"(?s)^({'' if anchored else '.*?'})(?-s:{pattern.removeprefix('^')})(.*)$", f"$1{java}{tail}")


def prefix(text: Column, size: int = 7) -> Column:
    """The first bytes, in hex."""
    return F.substring(F.hex(F.encode(text, "utf-8")), 1, 2 * size)


def fingerprint(text: Column) -> Column:
    """Bit b of the result is set if the UTF-8 text has a byte whose low five bits are b; null for null."""

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        filled = texts.fill_null("") if texts.null_count else texts
        wide = pa.types.is_large_string(filled.type)
        if len(filled):
            _, offsets, data = filled.buffers()
            at = np.frombuffer(offsets, np.int64 if wide else np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
            if data is not None and at[-1] > at[0]:
                bits = np.int64(1) << (np.frombuffer(data, np.uint8)[at[0] : at[-1]] & 31).astype(np.int64)
                there = np.diff(at) > 0
                out[there] = np.bitwise_or.reduceat(bits, (at[:-1] - at[0])[there])
        return pa.array(out, mask=~np.array(texts.is_valid(), bool))

    return F.arrow_udf(run, "bigint")(text)


def fingerprint_of(needle: str) -> int:
    out = 0
    for b in needle.encode():
        out |= 1 << (b & 31)
    return out


def may_contain(print_: Column, needle: str) -> Column:
    """Whether a text with that fingerprint can contain *needle*: never false for one that does."""
    want = F.lit(fingerprint_of(needle)).cast("bigint")
    return print_.bitwiseAND(want) == want
