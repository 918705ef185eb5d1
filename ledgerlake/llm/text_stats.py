"""Counts over whole texts, as one struct column."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import byte_slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_digits", "n_stops", "n_bangs", "longest_word")

RATIOS = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "distinct_share", "upper_share", "digit_share", "stop_share", "bang_share")

_TYPE = "struct<" + ", ".join(f"{n}: bigint" for n in COUNTS) + ">"


def _byte_classes() -> np.ndarray:
    """A row for each byte: starts a code point, white space, symbol, A-Z, letter, digit, full stop, exclamation or question mark."""
    m = np.zeros((256, 8), np.int64)
    m[:, 0] = [(b & 0xC0) != 0x80 for b in range(256)]
    for column, chars in ((1, b" \t\n\x0b\x0c\r"), (2, b"#*$%&|<>"), (5, b"0123456789"), (6, b"."), (7, b"!?")):
        m[list(chars), column] = 1
    m[65:91, 3] = 1
    m[65:91, 4] = m[97:123, 4] = m[0xC3:0xF5, 4] = 1
    return m


_CLASSES = _byte_classes()


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which occurs twice or more, its first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    codes = dict(zip(dict.fromkeys(words), count(), strict=False))
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    size = len(codes)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def count_text(data: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8."""
    words = data.split()
    points, spaces, symbols, upper, letters, digits, stops, bangs = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES).tolist()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (len(words), points - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)), upper, letters, digits, stops, bangs, max(map(len, words), default=0))


def count_batch(texts: pa.Array) -> np.ndarray:
    rows = [count_text(data) for part in byte_slices(texts) for data in part]
    return np.array(rows, np.int64).reshape(len(rows), len(COUNTS))


def text_counts(text: Column) -> Column:
    """Struct of COUNTS for a text; a null or empty text has 0 everywhere."""

    @F.arrow_udf(_TYPE)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = count_batch(texts)
            yield pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(COUNTS))], list(COUNTS))

    return counts(text)


_RATIO_OF = {
    "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"), "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"), "digit_share": ("n_digits", "word_chars"), "stop_share": ("n_stops", "n_words"), "bang_share": ("n_bangs", "n_words"),
}

FEATURES = COUNTS[:1] + RATIOS + ("longest_word",)


def feature_columns(counts: Column) -> dict[str, Column]:
    """The statistics that rules test, as Spark expressions over a counts struct."""
    out = {"n_words": counts["n_words"].cast("double"), "longest_word": counts["longest_word"].cast("double")}
    for name, (top, bottom) in _RATIO_OF.items():
        out[name] = counts[top].cast("double") / F.greatest(counts[bottom], F.lit(1)).cast("double")
    return {n: out[n] for n in FEATURES}


def feature_matrix(found: np.ndarray) -> np.ndarray:
    """The same statistics for fitting, a column for each of FEATURES."""
    at = {n: found[:, k].astype(float) for k, n in enumerate(COUNTS)}
    ratio = {n: at[top] / np.maximum(at[bottom], 1) for n, (top, bottom) in _RATIO_OF.items()}
    return np.column_stack([ratio[n] if n in ratio else at[n] for n in FEATURES]) if len(found) else np.zeros((0, len(FEATURES)))


def thresholds(values: np.ndarray, most: int = 32) -> np.ndarray:
    """Midpoints between neighbouring quantiles, to split at."""
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, most + 1))) if len(values) else np.zeros(0)
    return (cuts[1:] + cuts[:-1]) / 2
