"""Byte-level BPE by merge ranks, encoding and decoding.

Text is split by the tokenizer's pattern. A piece that is a token is done; in any other, a segment tree over its byte
positions keeps the smallest pair rank of every range, the leftmost among equals. Its root names the next merge, and each
merge updates the leaves of three neighbours at most, each in a logarithmic number of steps, so a piece of n bytes takes
n log n steps even if it is a whole text of one letter. Short pieces that a slice of texts brings anew are merged side by
side: their trees are the columns of one array, and every round makes the next merge of each.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from codecensus.llm.common import slices

#: Rank of a pair that is no token.
NEVER = 1 << 62
#: Texts longer than this are split piece by piece, so that their pieces are not all held at once.
LONG_TEXT = 1_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token -> rank of a rank file: a base64 token and its rank on each line."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of a piece: the pair of smallest rank, leftmost first, is merged until no pair is a token."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    follows = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    rank = ranks.get
    # A leaf is rank * n + position, so that a minimum is also the leftmost.
    leaves = [NEVER if (r := rank(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    tree = [NEVER] * size + leaves + [NEVER] * (size - n + 1)
    for at in range(size - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right

    def put(position: int, value: int) -> None:
        at = size + position
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            least = value if value < other else other
            at >>= 1
            if tree[at] == least:
                return
            tree[at] = value = least

    def pair(start: int, end: int) -> int:
        found = rank(piece[start:end]) if end - start <= longest else None
        return NEVER if found is None else found * n + start

    while tree[1] < NEVER:
        i = tree[1] % n
        j = follows[i]
        k = follows[j]
        follows[i] = k
        if k < n:
            put(j, NEVER)
            before[k] = i
            put(i, pair(i, follows[k]))
        else:
            # The last part heads no pair, so the leaf of j is empty already.
            put(i, NEVER)
        if before[i] >= 0:
            put(before[i], pair(before[i], k))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : follows[i]]])
        i = follows[i]
    return ids


class Merges:
    """Ranks of a vocabulary, by bytes and by pairs of ids."""

    #: Pieces with more pairs of bytes than this are merged one by one.
    MOST_LEAVES = 64

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.ranks, self.longest, self.width = ranks, max(map(len, ranks)), max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[token[:k]] * self.width + ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        table = np.array(sorted(pairs) or [(-1, 0)], np.int64)
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()

    def keys(self, left: np.ndarray, right: np.ndarray, position: np.ndarray, span: int) -> np.ndarray:
        """Leaves of pairs of ids: rank * span + position, or NEVER."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at] * span + position, NEVER)

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out = [b""] * len(pieces)
        alike: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = struct.pack("<I", whole)
            elif piece:
                alike.setdefault(1 << max(0, len(piece) - 2).bit_length(), []).append(k)
        for leaves, rows in alike.items():
            if leaves > self.MOST_LEAVES:
                made = [np.array(merged(pieces[k], self.ranks, self.longest), "<u4").tobytes() for k in rows]
            else:
                made = self._side_by_side([pieces[k] for k in rows], leaves)
            for k, ids in zip(rows, made, strict=True):
                out[k] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        span = leaves + 1
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(span, b"\0") for p in pieces), np.uint8).reshape(len(pieces), span)
        live = np.arange(span) < n[:, None]
        ids = self.single[raw]
        follows = np.tile(np.arange(1, span + 2), (len(pieces), 1))
        before = np.tile(np.arange(-1, span), (len(pieces), 1))
        tree = np.full((2 * leaves + 1, len(pieces)), NEVER)
        tree[leaves : 2 * leaves] = np.where(live[:, 1:], self.keys(ids[:, :-1], ids[:, 1:], np.arange(leaves), span), NEVER).T
        for at in range(leaves - 1, 0, -1):
            tree[at] = np.minimum(tree[2 * at], tree[2 * at + 1])

        def put(row: np.ndarray, position: np.ndarray, value: np.ndarray | int) -> None:
            at = leaves + position
            tree[at, row] = value
            for _ in range(leaves.bit_length() - 1):
                at = at >> 1
                tree[at, row] = np.minimum(tree[2 * at, row], tree[2 * at + 1, row])

        while len(row := np.flatnonzero(tree[1] < NEVER)):
            rank, i = np.divmod(tree[1, row], span)
            j = follows[row, i]
            k = follows[row, j]
            ids[row, i] = rank
            live[row, j] = False
            follows[row, i] = k
            before[row, k] = i
            # The last place has no leaf of its own.
            has = j < leaves
            put(row[has], j[has], NEVER)
            ahead = k < n[row]
            put(row, i, np.where(ahead, self.keys(rank, ids[row, np.minimum(k, span - 1)], i, span), NEVER))
            p = before[row, i]
            has = p >= 0
            row, p, rank = row[has], p[has], rank[has]
            put(row, p, self.keys(ids[row, p], rank, p, span))
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@lru_cache(1)
def younger() -> str:
    """Letters and numbers of the pattern library that the tokenizer library does not know yet, as ranges of a character class."""
    try:
        import tiktoken
    except ModuleNotFoundError:
        return ""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    ranges: list[list[int]] = []
    for kind in (r"\p{L}", r"\p{N}"):
        known = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        for code in sorted(map(ord, set(regex.findall(kind, every)) - set(bytes(known).decode()))):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Encoder:
    """Encodes texts a slice at a time; the ids of pieces are kept for later slices, and forgotten when they are many."""

    MOST_PIECES, LONGEST_KEPT = 200_000, 64

    def __init__(self, raw: bytes, pattern: str, young: str):
        self.merges = Merges(read_ranks(raw))
        self.pattern = regex.compile(pattern)
        self.young = regex.compile(f"[{young}]") if young else None
        self.youngest = int(young[2:10], 16) if young else 0
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> Iterator[str]:
        if self.young is not None and not text.isascii():
            # Most texts have no character so high in the tables that it could be a young one.
            if np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max() >= self.youngest and self.young.search(text):
                # It counts as neither letter nor number; a private one stands for it while the text is split.
                stand_in = self.young.sub("\ue000", text)
                return (text[m.start() : m.end()] for m in self.pattern.finditer(stand_in))
        if len(text) > LONG_TEXT:
            return (m.group() for m in self.pattern.finditer(text))
        return iter(self.pattern.findall(text))

    def learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > self.MOST_PIECES:
            self.known.clear()
            new = pieces
        new = list(new)
        self.known.update(zip(new, self.merges.packed([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))

    def packed(self, texts: list[str | None]) -> list[bytes]:
        out, held = [], []
        for text in texts:
            if text and len(text) > LONG_TEXT:
                rest, parts = self.split(text), []
                while part := list(islice(rest, LONG_TEXT)):
                    parts.append(self._joined([part])[0])
                held.append(None)
                out.append(b"".join(parts))
            else:
                held.append(list(self.split(text or "")))
                out.append(b"")
        short = iter(self._joined([h for h in held if h is not None]))
        return [o if h is None else next(short) for o, h in zip(out, held, strict=True)]

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        pieces = set().union(*texts)
        self.learn(pieces)
        made = [b"".join(map(self.known.__getitem__, text)) for text in texts]
        for piece in pieces:
            if len(piece) > self.LONGEST_KEPT:
                del self.known[piece]
        return made


def vocabulary(path: str | None = None) -> bytes:
    """Bytes of a rank file; by default that of the installed 50,256-token vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        return file.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, ids), ``ids`` the tokens as little-endian unsigned 32-bit integers.

    Whole texts, each match of the pattern on its own, no special tokens. The rank file is read by the driver and sent
    with the task; it must hold every byte. Null texts are empty and have no tokens; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    raw, splits, young = vocabulary(ranks_path), pattern or split_pattern(), younger()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(raw, splits, young)
        for batch in slices(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": encoder.packed(list(batch["text"]))})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(work, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(ids: Column, *, ranks_path: str | None = None) -> Column:
    """Bytes of packed ids. They are the text's UTF-8 if the ids are all of its tokens. Null stays null."""
    raw = vocabulary(ranks_path)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {rank: piece for piece, rank in read_ranks(raw).items()}
        for batch in batches:
            yield pd.Series([None if b is None else b"".join(map(token.__getitem__, np.frombuffer(b, "<u4").tolist())) for b in batch], dtype=object)

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(work, "binary")(ids)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def token_ids(ids: Column) -> Column:
    """Packed ids as an array of numbers, without Python."""
    digits = F.hex(ids)
    one = lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), token_count(ids).cast("int") - 1), one)).when(ids.isNotNull(), F.array().cast("array<bigint>"))
