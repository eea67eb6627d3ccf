"""Fill-in-the-middle transformation with cuts at lines, code points or bytes.

Text is cut as UTF-8. Only the characters of more than one byte are listed, with their code point positions and the bytes
they have in excess: between them one place is one byte, so a cut is turned from code points into bytes, or back, by a
binary search in the list and an addition. A text of ASCII has an empty list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codecensus.llm.common import slices

#: Put before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char", "byte")


class CutIndex:
    """Bytes of a text and its sparse list of multibyte characters."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        self.bytes = np.frombuffer(raw, np.uint8)
        #: Byte position of each multibyte character, the excess bytes before each and, last, of all.
        self.at = np.flatnonzero(self.bytes >= 0xC0)
        lead = self.bytes[self.at]
        self.width = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.width - 1)])
        self.position = self.at - self.excess[:-1]

    def chars(self) -> int:
        return self.size - int(self.excess[-1])

    def to_byte(self, position: int) -> int:
        return position + int(self.excess[np.searchsorted(self.position, position)])

    def to_char(self, byte: int) -> int:
        """Code points before a byte that begins a character, or before the end."""
        return byte - int(self.excess[np.searchsorted(self.at, byte)])

    def snapped(self, byte: int) -> int:
        """The byte itself, or the start of the character it lies in."""
        k = int(np.searchsorted(self.at, byte, "right")) - 1
        return int(self.at[k]) if k >= 0 and byte < self.at[k] + self.width[k] else byte

    def line_ends(self) -> np.ndarray:
        ends = np.flatnonzero(self.bytes == 10) + 1
        return ends if self.size == 0 or (len(ends) and ends[-1] == self.size) else np.append(ends, self.size)


def cuts(index: CutIndex, unit: str, first: int, second: int) -> tuple[int, int, int]:
    """(units, byte of the smaller cut, byte of the larger cut); the cuts are the draws modulo units + 1."""
    ends = index.line_ends() if unit == "line" else None
    n = len(ends) if unit == "line" else index.chars() if unit == "char" else index.size
    low, high = sorted((first % (n + 1), second % (n + 1)))
    if unit == "line":
        low, high = (int(ends[k - 1]) if k else 0 for k in (low, high))
    elif unit == "char":
        low, high = index.to_byte(low), index.to_byte(high)
    else:
        low, high = index.snapped(low), index.snapped(high)
    return n, low, high


def transformed(text: str | None, digest: str, unit: str, percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``digest`` gives the draws, eight hexadecimal digits each."""
    text = text or ""
    first, second, whether, which = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    raw = text.encode("utf-8", "surrogatepass")
    index = CutIndex(raw)
    n, low, high = cuts(index, unit, first, second)
    if not text or whether % 100 >= percent or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    prefix, middle, suffix = (part.decode("utf-8", "surrogatepass") for part in (raw[:low], raw[low:high], raw[high:]))
    p, s, m = sentinels
    spm = which % 100 < spm_percent
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    head = index.to_char(low)
    return n, "spm" if spm else "psm", head, index.to_char(high) - head, output


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must not overlap one another: then none can arise where a part of a text meets one, and outputs can be undone."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and a in b) or len(set(sentinels)) < 3:
                raise ValueError(f"sentinels overlap: {sentinels}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", percent: int = 100, spm_percent: int = 50,
                   sentinels: tuple[str, str, str] = SENTINELS, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n, form, prefix_chars, middle_chars, output).

    ``n`` units (lines with their line feed, code points or bytes); cuts between units come from the SHA-256 of seed and
    id, so reruns and repeated rows agree, and a null id is written as the word null. ``percent`` of the texts are
    transformed, ``spm_percent`` of these with the suffix first. Null texts are empty; empty texts and those that contain
    a sentinel stay plain, with null counts. A cut inside a character moves to its start. Whole texts of any length are
    cut. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    _check(sentinels)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [transformed(t, d, unit, percent, spm_percent, sentinels) for t, d in zip(batch["text"], batch["digest"], strict=True)]
            made = pd.DataFrame(rows, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            yield pd.concat([batch[["doc_id"]], made], axis=1)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text of an output and its form.

    A transformed text holds no sentinel of its own and none arises where parts meet, so splitting at the sentinels
    gives the three parts back.
    """
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), 4)
    second, third, fourth = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(third, fourth, second)).otherwise(F.concat(second, fourth, third))
