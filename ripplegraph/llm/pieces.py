"""Encoding whole texts piece by piece with the tokenizers library.

A tokenizer whose pre-tokens never reach over certain places gives the same ids for a text as for its parts
between those places. Parts recur, so each worker encodes a part once and looks it up afterwards.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Before a space that follows something surely not white space a byte-level pre-token always starts.
BEFORE_SPACE = re.compile(r"(?<![\s\u180e])(?= )")
#: Whatever may be white space, before a space, as the library of pyarrow writes it.
ODD_SPACE_RE2 = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}\x{180e}] "
#: Between one of these letters and a comma or full stop at a part's end a pre-token always ends.
BEFORE_MARK_RE2 = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])[,.]\z"
#: What may follow a part that is cut there; nothing has no ids.
MARKS = ("", ",", ".")
NOTHING, SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


def split_dropping_space(text: str) -> list[str]:
    """For tokenizers that drop white space: the parts between spaces and line ends."""
    return text.replace("\n", " ").split(" ")


def split_keeping_space(text: str) -> list[str]:
    """For byte-level tokenizers: parts that start with their space. Joined, they are the text."""
    return BEFORE_SPACE.split(text)


class PieceEncoder:
    """ids of texts, equal to tokenizer.encode(text, add_special_tokens=False).ids.

    most_pieces and most_chars bound the worker's memory: a full store keeps the pieces that recurred.
    """

    def __init__(self, path: str, keep_space: bool, most_pieces: int = 500_000, most_chars: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.keep_space = keep_space
        self.split = split_keeping_space if keep_space else split_dropping_space
        self.most, self.most_chars = most_pieces, most_chars
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = self.chars = 0
        self.start, self.length, self.asked = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.add(list(MARKS), *self.joined(list(MARKS)))

    def shrink(self) -> None:
        """Drops what was asked for once only since the last time; everything, where that leaves over half of the bounds."""
        names, keep = list(self.row), len(MARKS) + np.flatnonzero(self.asked[len(MARKS) : len(self.row)] > 1)
        names = [names[i] for i in keep.tolist()]
        flat, bounds = self.gathered(keep, np.ones(len(keep), np.int64))
        self.clear()
        if 2 * len(names) <= self.most and 2 * sum(map(len, names)) <= self.most_chars:
            self.add(names, flat, np.diff(bounds))

    def joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces and how many each has.

        Pieces go to the library some hundred at a time, between copies of a special token: the library cuts
        a text at special tokens before anything else, so each piece is encoded by itself.
        """
        texts = [self.mark.join(pieces[i : i + 256]) + self.mark for i in range(0, len(pieces), 256)] if self.mark else []
        if sum(t.count(self.mark) for t in texts) != len(pieces):  # no mark, or a piece holds it
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths
        found = [np.array(e.ids, np.uint32) for i in range(0, len(texts), 16) for e in self.tokenizer.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def add(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, total = len(self.row), int(lengths.sum())
        while len(self.start) < n + len(pieces):
            self.start, self.length, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.asked))
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + total] = flat
        self.start[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(pieces)] = lengths
        self.used += total
        self.chars += sum(map(len, pieces))
        self.row.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def rows_of(self, pieces: list[str]) -> np.ndarray:
        """Rows of distinct pieces; unknown ones are learnt first."""
        rows, unknown, new = self.looked_up(pieces)
        if len(self.row) > len(MARKS) and (len(self.row) + len(new) > self.most or self.chars + sum(map(len, new)) > self.most_chars):
            self.shrink()
            rows, unknown, new = self.looked_up(pieces)
        if new:
            rows[unknown] = np.arange(len(self.row), len(self.row) + len(new))
            self.add(new, *self.joined(new))
        self.asked[rows] += 1
        return rows

    def looked_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Rows of pieces, and those that have none: their places and themselves."""
        rows = np.fromiter(map(self.row.get, pieces, repeat(-1)), np.int32, len(pieces))
        unknown = np.flatnonzero(rows < 0)
        return rows, unknown, [pieces[i] for i in unknown.tolist()]

    def gathered(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of these rows, and bounds of texts of so many pieces each."""
        lengths = self.length[rows]
        ends = np.cumsum(lengths, dtype=np.int64)
        at = np.repeat((self.start[rows] - ends + lengths).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def with_marks(self, rows: np.ndarray, mark: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """gathered, where MARKS[mark] follows each row; the store has them as its first rows."""
        both = np.empty((len(rows), 2), np.int32)
        both[:, 0], both[:, 1] = rows, mark
        return self.gathered(both.ravel(), 2 * counts)

    def slowly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [self.split(text) for text in texts]
        distinct = list({p for parts in own for p in parts})
        row = dict(zip(distinct, self.rows_of(distinct).tolist(), strict=True))
        counts = np.fromiter(map(len, own), np.int64, len(own))
        return self.gathered(np.fromiter((row[p] for parts in own for p in parts), np.int64, int(counts.sum())), counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of non-null texts one after another, and where each text starts in them (with the end)."""
        texts = pc.cast(texts, pa.large_string())
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        if self.keep_space:
            odd = pc.match_substring_regex(texts, ODD_SPACE_RE2).to_numpy(zero_copy_only=False)
            if odd.any():
                order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
                a, at_a = self.encode(texts.filter(pa.array(~odd)))
                b, at_b = self.slowly(texts.filter(pa.array(odd)).to_pylist())
                both, starts = np.concatenate([a, b]), np.concatenate([at_a[:-1], at_b[:-1] + len(a)])
                lengths = np.concatenate([np.diff(at_a), np.diff(at_b)])
                back = np.argsort(order)
                starts, lengths = starts[back], lengths[back]
                ends = np.cumsum(lengths)
                return both[np.repeat(starts - ends + lengths, lengths) + np.arange(len(both))], np.concatenate([[0], ends])
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        found = parts.flatten().dictionary_encode()
        index = found.indices.to_numpy()
        bare = pc.replace_substring_regex(found.dictionary, BEFORE_MARK_RE2, r"\1")
        cut = pc.not_equal(pc.binary_length(bare), pc.binary_length(found.dictionary)).to_numpy(zero_copy_only=False)
        mark = np.where(cut, np.where(pc.ends_with(found.dictionary, ",").to_numpy(zero_copy_only=False), 1, 2), 0).astype(np.int8)[index]
        bare = bare.dictionary_encode()
        distinct, index = bare.dictionary, bare.indices.to_numpy()[index]
        if not self.keep_space:
            return self.with_marks(self.rows_of(distinct.to_pylist())[index], mark, counts)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        known = pc.binary_join_element_wise(NOTHING, distinct, SPACE).to_pylist()
        leading = distinct.take(pa.array(index[at])).to_pylist()
        first = list(set(leading).difference(known))
        rows = self.rows_of(first + known)[len(first) :][index]
        rows[at] = [self.row[p] for p in leading]
        return self.with_marks(rows, mark, counts)


def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """One for each worker process, kept between its tasks."""
    return kept(("pieces", path, keep_space), lambda: PieceEncoder(path, keep_space))
