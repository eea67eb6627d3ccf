"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against it: every
phrase is the longest match with the labelled text that starts where the last one ended. Phrases times the logarithm of
the sample's size, over the text's length, estimates the cross entropy; the language with the least wins.

Parsing walks all texts of a batch at once: texts are cut into pieces of equal length (a phrase ends at the end of its
piece) and one step moves every piece by one symbol in every language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codecensus.llm.common import slices
from codecensus.llm.native import bounded
from codecensus.session import cut

SPACE, BREAK, UNKNOWN, FIRST = 0, 1, 2, 3
PIECE = 512
#: Sizes of the labelled sample: documents and pieces of text for each language, code points in a piece.
SAMPLE_DOCUMENTS, SAMPLE_PIECES, SAMPLE_PIECE = 64, 40, 1000
#: Pieces that move together.
BLOCK = 16384

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes(text: str | None) -> np.ndarray:
    """Lower-cased code points; each run of anything but letters is one space (0)."""
    found = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.where(is_letter()[found], found, 0)
    return found[(found != 0) | (np.concatenate(([1], found[:-1])) != 0)] if len(found) else found


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@dataclass
class Model:
    """Automata of all languages in one pair of arrays.

    The move of state s by symbol c stands in cell ``base[s] + c`` if the cell's owner is s; rows overlap. ``cells`` holds
    owner * 2**32 + target. ``start[l, c]`` is where a phrase of language l that begins with c leads.
    """

    languages: list[str]
    cost: np.ndarray
    alphabet: np.ndarray
    base: np.ndarray
    cells: np.ndarray
    start: np.ndarray

    def symbols(self, text: str | None) -> np.ndarray:
        found = codes(text)
        at = np.searchsorted(self.alphabet, found)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == found if len(self.alphabet) else np.zeros(len(found), bool)
        return np.where(found == 0, SPACE, np.where(known, at + FIRST, UNKNOWN)).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)))
        pieces = [(i, t[k : k + PIECE]) for i, t in enumerate(texts) for k in range(0, len(t), PIECE)]
        pieces.sort(key=lambda p: -len(p[1]))
        for k in range(0, len(pieces), BLOCK):
            block = pieces[k : k + BLOCK]
            sizes = np.array([len(p) for _, p in block])
            wide = np.zeros((sizes[0], len(block)), np.int32)
            for j, (_, p) in enumerate(block):
                wide[: len(p), j] = p
            state = np.repeat(np.arange(len(self.languages)), len(block)).reshape(len(self.languages), -1)
            count = np.zeros(state.shape, np.int32)
            for step in range(sizes[0]):
                n = int(np.searchsorted(-sizes, -step))  # pieces that have a symbol left
                c, s = wide[step, :n], state[:, :n]
                cell = self.cells[self.base[s] + c]
                goes = (cell >> 32) == s
                count[:, :n] += ~goes
                state[:, :n] = np.where(goes, cell & 0xFFFFFFFF, self.start[:, c])
            np.add.at(out, [i for i, _ in block], count.T)
        return out

    def decide(self, texts: pd.Series) -> pd.DataFrame:
        symbols = [self.symbols(t) for t in texts]
        letters = np.array([int((s != SPACE).sum()) for s in symbols], np.int64)
        if not self.languages:
            return pd.DataFrame({"lang_pred": "und", "score": 0.0, "n_letters": letters, "phrase_length": 0.0}, index=texts.index)
        phrases = self.phrases(symbols)
        bits = phrases * self.cost
        best = bits.argmin(axis=1)
        rows = np.arange(len(best))
        score = 1 / np.exp(np.maximum(-700, bits[rows, best][:, None] - bits)).sum(axis=1)
        return pd.DataFrame({
            "lang_pred": np.where(letters > 0, np.array(self.languages, object)[best], "und"), "score": np.where(letters > 0, score, 0.0),
            "n_letters": letters, "phrase_length": letters / np.maximum(1, phrases[rows, best])}, index=texts.index)


def _placed(moves: list[dict[int, int]], width: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, cells) of one automaton, see ``Model``: state 1 is number ``first`` of the model, state 0 and breaks have no cells."""
    base = np.zeros(len(moves) - 1, np.int64)
    own: list[int] = [-1 << 32] * width
    free = tried_from = width
    order = sorted(range(1, len(moves)), key=lambda s: (-sum(c != BREAK for c in moves[s]), s))
    for state in order:
        move = [(c, t) for c, t in moves[state].items() if c != BREAK]
        if not move:
            continue
        while free < len(own) and own[free] >= 0:
            free += 1
        # A row with one move takes the first free cell; wider rows leave crowded cells behind for these.
        low, at = min(c for c, _ in move), free if len(move) == 1 else max(free, tried_from)
        begun = at
        while any(at - low + c < len(own) and own[at - low + c] >= 0 for c, _ in move):
            at += 1
        if at - begun > 16:
            tried_from = at - 8
        base[state - 1] = at - low
        own += [-1 << 32] * (at - low + width - len(own))
        for c, t in move:
            own[at - low + c] = (state + first - 1 << 32) + t + first - 1
    return base, np.array(own, np.int64)


def build(samples: dict[str, list[str]]) -> Model:
    """Model of labelled texts by language. Languages are in order of their names; of equal costs the first wins."""
    languages = sorted(samples)
    coded = {lang: [codes(t) for t in sorted(samples[lang])] for lang in languages}
    alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *(c for cs in coded.values() for c in cs)]))
    alphabet = alphabet[alphabet != 0]
    width = len(alphabet) + FIRST
    # States 0 .. languages - 1 are the starts; they own no cell, so that every phrase is counted where it begins.
    start = np.tile(np.arange(len(languages))[:, None], width)
    # Languages take cells one after the other, so that the dicts of one at a time are held.
    bases, cells, cost = [np.zeros(len(languages), np.int64)], [], []
    first, begin = len(languages), 0
    for number, lang in enumerate(languages):
        symbols: list[int] = []
        for c in coded[lang]:
            symbols += [SPACE if x == 0 else int(i) + FIRST for x, i in zip(c, np.searchsorted(alphabet, c), strict=True)] + [BREAK]
        moves = suffix_automaton(symbols)
        shift = first - 1  # state 0 of the automaton is the start itself
        for c, target in moves[0].items():
            start[number, c] = target + shift
        base, own = _placed(moves, width, first)
        bases.append(base + begin)
        cells.append(own)
        first, begin = first + len(base), begin + len(own)
        cost.append(math.log(max(2, len(symbols))))
    base = np.concatenate(bases)
    cells = np.concatenate([*cells, np.full(2 * width + 1, -1 << 32, np.int64)])
    return Model(languages, np.array(cost), alphabet, base, cells, start)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, seed: int = 7,
          documents: int = SAMPLE_DOCUMENTS, pieces: int = SAMPLE_PIECES, piece: int = SAMPLE_PIECE) -> Model:
    """Fit on a bounded sample: for each language ``documents`` whole labelled texts, of which ``pieces`` pieces are used.

    Which rows may be used is for the caller to filter. Rows without a text, a language or an id are not used.
    """
    rows = docs.where(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # A hash below a bound that follows from the language's count leaves a few times the sample before rows are ranked.
    counts = bounded(cut(rows.groupBy("lang").agg(F.count("*").alias("n"))).select(F.col("lang").alias("of"), "n"))
    dice = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**40)) / 2**40
    few = rows.withColumn("dice", dice).join(counts, F.expr("lang = of")).where(F.col("dice") * F.col("n") < 4 * documents + 16)
    order = Window.partitionBy("lang").orderBy("dice", "id")
    chosen = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= documents).select("id").distinct()
    texts = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "id")  # at most ``documents`` rows for each language
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(piece))
    cut_up = texts.select("id", "lang", F.explode(F.transform(cuts, lambda k: F.struct(k.alias("k"), F.substring("text", k + 1, F.lit(piece)).alias("part")))).alias("p"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", "p.k", F.lit(seed)), "id", "p.k", "p.part")
    part = cut_up.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pieces).select("lang", "p.part")
    samples: dict[str, list[str]] = {}
    for row in part.toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["part"])
    return build(samples)


def language(model: Model, text: Column) -> Column:
    """struct(lang_pred, score, n_letters, phrase_length) of a text column."""
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            # A column function answers a batch with one frame; the texts are parsed a few at a time.
            yield pd.concat([model.decide(part) for part in slices([texts])] or [model.decide(texts)], ignore_index=True)

    decide.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(decide, "lang_pred string, score double, n_letters long, phrase_length double")(text)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, lang_pred, score, n_letters, phrase_length).

    Rows that are held out teach nothing. Null texts and texts without a letter are ``und`` with score 0, as is all if no
    row has a label. ``score`` is the winner's share when costs are read as code lengths; ``phrase_length`` letters per
    phrase. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    model = learn(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return found.withColumn("found", language(model, F.col("text"))).select("doc_id", "held_out", "found.*")
