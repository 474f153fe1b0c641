"""Token counts of whole texts, as the tokenizer of a file gives them.

Texts go through an Arrow function that returns lengths only. They are cut where the byte-level splitter starts a new word in
any case, so that the pieces' counts add up to the text's count: before a blank, tab or line break that follows a character
that is no white space, and, in a piece longer than ``piece_bytes``, between an ASCII letter and an ASCII digit or between a
letter of a common script and a full stop or comma; never inside the spelling of an added token. A stretch without such a
place stays whole. A piece that was met before has its count remembered (for so many pieces at most); new ones go to the
encoder in batches of about ``batch_bytes`` of text whatever their number.

Nulls and edges: a null or empty text has no tokens and no bytes; repeated rows are counted each for itself; a null doc_id is
kept; an empty table gives an empty table; other columns are left alone. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices, texts_of

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
INSIDE = re.compile(f"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[{LETTERS}])(?=[.,;:!?。，、！？])")
BLANKS = " \t\n\r"
WORD = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
OTHER_SPACE = re.compile(r"[^\S \t\n\r]")
BEFORE_BLANK = re.compile(f"(?<=\\S)(?=[{BLANKS}])")


def words(text: str) -> list[str]:
    """A text in pieces that begin with a blank, tab or line break after a character that is no white space."""
    return BEFORE_BLANK.split(text) if OTHER_SPACE.search(text) else WORD.findall(text)


class Pieces:
    """Cuts long pieces further at safe places for a tokenizer with these added tokens."""

    def __init__(self, added: list[str], size: int):
        self.added, self.size = [a for a in added if a], size

    def splits_added(self, text: str, at: int) -> bool:
        return any(a in text[max(0, at - len(a) + 1) : at + len(a) - 1] for a in self.added)

    def cut(self, text: str) -> Iterator[str]:
        """Pieces of ``size`` characters or a little more; longer only where no place is safe."""
        start = 0
        while len(text) - start > self.size:
            safe = (m.start() for m in INSIDE.finditer(text, start + self.size))
            at = next((k for k in safe if not self.splits_added(text, k)), None)
            if at is None:
                break
            yield text[start:at]
            start = at
        yield text[start:]


class Counter:
    """Counts of pieces by the file's tokenizer, without truncation and padding; ``bound`` of them are remembered at least, twice as many at most."""

    bound = 200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = any(re.search(r"\s", a) for a in self.added)  # such a token could lie across pieces
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return [text] if self.spaced else words(text)

    def know(self, pieces: set[str], piece_bytes: int, batch_bytes: int) -> dict[str, int]:
        """Counts of all of ``pieces``, and of others."""
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = pieces.difference(young)
        young.update((p, old[p]) for p in new & old.keys())
        new = list(new.difference(young))
        young.update(dict.fromkeys(new, 0))
        cut = Pieces(self.added, piece_bytes)
        for rows, parts in batched(((i, c) for i, p in enumerate(new) for c in ([p] if self.spaced else cut.cut(p))), batch_bytes):
            for i, e in zip(rows, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
                young[new[i]] += len(e)
        return young


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The file's counter, read once in a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def batched(pieces: Iterator[tuple[int, str]], limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Neighbouring pieces up to about ``limit`` characters."""
    rows, texts, held = [], [], 0
    for row, text in pieces:
        if texts and held + len(text) > limit:
            yield rows, texts
            rows, texts, held = [], [], 0
        rows.append(row)
        texts.append(text)
        held += len(text)
    if texts:
        yield rows, texts


def segments(text: str, size: int) -> Iterator[str]:
    """A long text in stretches of ``size`` characters or a little more, cut before blanks."""
    start = 0
    while len(text) - start > size and (found := BEFORE_BLANK.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def lengths(texts: list[str], path: str, piece_bytes: int = 1 << 16, batch_bytes: int = 1 << 20) -> np.ndarray:
    """The number of tokens of each text."""
    found, counts = counter(path), np.zeros(len(texts), np.int64)
    stretches = ((i, s) for i, t in enumerate(texts) for s in ([t] if found.spaced else segments(t, batch_bytes)))
    for rows, parts in batched(stretches, batch_bytes):
        pieces = [found.pieces(p) for p in parts]
        known = found.know(set().union(*pieces), piece_bytes, batch_bytes)
        np.add.at(counts, rows, [sum(map(known.__getitem__, p)) for p in pieces])
    return counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, piece_bytes: int = 1 << 16, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=batch_bytes):
            raw = texts_of(batch)
            n = lengths([t.decode("utf-8", "replace") for t in raw], tokenizer, piece_bytes, batch_bytes)
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, COUNTS)
