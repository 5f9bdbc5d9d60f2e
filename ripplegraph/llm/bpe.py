"""BPE encoding and decoding in numpy, for tokenizer files of the tokenizers library.

Encoding: the symbols of all words to encode stand in one flat array. In each round every neighbouring pair is looked
up by binary search over the sorted keys of all merges, each word takes its lowest-ranked pair, and all its places are
merged from left to right. Words drop out when no pair of theirs can merge. Merging all places of a pair at once gives
what merging one by one does, as every pair with a merged symbol ranks after the merge that makes it; `Bpe` checks that
of the file it reads and otherwise merges the leftmost place only.

Reads: normalizers NFC, Replace and Lowercase; pre-tokenizers Split (isolating matches) and ByteLevel; added tokens that
are found in raw text; no decoder or ByteLevel. Anything else raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept

#: The byte-level alphabet writes these bytes as themselves, and the others, in order, from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: the byte-level pre-tokenizer's own pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as that library's patterns have it; Python's \s has four control characters more.
SPACE = r"\t\n\v\f\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(PRINTED) else chr(next(other)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, most_pieces: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        norm = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        self.normal = norm["normalizers"] if norm["type"] == "Sequence" else [norm]
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]), BYTE_LEVEL if steps[-1].get("use_regex") else None)
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges") or steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"] or len(steps) > 2 or not pattern or {n["type"] for n in self.normal} - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"{path}: a kind of tokenizer that isn't read here")
        fixed = lambda p: regex.compile(p.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}"))
        self.word = fixed(pattern)
        self.replace = [(fixed(n["pattern"]["Regex"]) if "Regex" in n["pattern"] else regex.compile(regex.escape(n["pattern"]["String"])), n["content"]) if n["type"] == "Replace" else n["type"] for n in self.normal]
        added = [t for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: an added token of a kind that isn't read here")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.keep_space = pattern == BYTE_LEVEL
        self.letters_together = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and [n["type"] for n in self.normal] == ["NFC", "Replace", "Lowercase"]
        decoder = spec["decoder"]
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError(f"{path}: a decoder that isn't read here")
        self.joined = decoder is None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.letter = np.array([self.vocab[x] for x in letters], np.int64)
        self.last = np.array([self.vocab[x + self.suffix] for x in letters], np.int64)
        self.byte_of = {x: b for b, x in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, to = (np.array([self.vocab[x] for x in col], np.int64) for col in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        rank = np.arange(len(pairs))
        first = np.full(len(self.names), len(pairs))
        np.minimum.at(first, to, rank)
        self.all_at_once = bool((np.maximum(np.where(np.isin(left, to), first[left], -1), np.where(np.isin(right, to), first[right], -1)) < rank).all()) and len(np.unique(to)) == len(to)
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.rank, self.to = (left << 32 | right)[order], rank[order], to[order]
        self.most = most_pieces
        self.known: dict[str, tuple[int, str, str]] = {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of non-empty words one after another, and how many each has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.letter[raw]
        symbol[np.cumsum(length) - 1] = self.last[raw[np.cumsum(length) - 1]]
        active = np.arange(len(words))
        none = len(self.keys)
        done_ids, done_words = [], []
        while len(active):
            start = np.cumsum(length) - length
            pair = np.empty(len(symbol), np.int64)
            pair[:-1] = symbol[:-1] << 32 | symbol[1:]
            pair[start + length - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.where(self.keys[at] == pair, self.rank[at], none)
            lowest = np.minimum.reduceat(rank, start)
            live = lowest < none
            owner = np.repeat(np.arange(len(active)), length)
            hit = (rank == lowest[owner]) & live[owner]
            if self.all_at_once:  # in runs of places that overlap, each second one
                place = np.flatnonzero(hit)
                if len(place):
                    fresh = np.concatenate([[True], np.diff(place) != 1])
                    run = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
                    hit[place[(place - run) % 2 == 1]] = False
            else:
                place = np.flatnonzero(hit)
                hit[:] = False
                hit[place[np.unique(owner[place], return_index=True)[1]]] = True
            place = np.flatnonzero(hit)
            symbol[place] = self.to[at[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            length = length - np.bincount(owner[place], minlength=len(active))
            symbol, owner = symbol[keep], owner[keep]
            ended = ~live
            if ended.any():
                mine = ended[owner]
                done_ids.append(symbol[mine])
                done_words.append(active[owner[mine]])
                symbol, active, length = symbol[~mine], active[live], length[live]
        ids, of = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))

    def normalized(self, text: str) -> str:
        for step in self.replace:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                text = text.replace("Σ", "σ").lower()
            else:
                text = step[0].sub(step[1], text)
        return text

    def words(self, text: str) -> list[bytes | int]:
        """Pre-tokens of a text, and the ids of added tokens between them."""
        if self.letters_together:  # letters alone, or one mark after them: what the pattern does, without it
            plain = (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()
            if plain.isalpha():
                return [plain.encode()]
            if plain[-1:] in ",.;:!?" and plain[:-1].isalpha():
                return [plain[:-1].encode(), plain[-1].encode()]
        found: list[bytes | int] = []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.added:
                found.append(self.added[part])
            elif part:
                found += [w.encode("utf-8", "replace") for w in self.word.findall(self.normalized(part))]
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        """ids of each text, as the library's encode(text, add_special_tokens=False) gives them."""
        own = [self.words(t) for t in texts]
        distinct = list({w for words in own for w in words if isinstance(w, bytes)})
        ids: dict = {}
        if distinct:
            flat, counts = self.merge(distinct)
            flat, ends = flat.tolist(), np.cumsum(counts).tolist()
            ids = {w: flat[b - n : b] for w, b, n in zip(distinct, ends, counts.tolist(), strict=True)}
        return [[i for w in words for i in ([w] if isinstance(w, int) else ids[w])] for words in own]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        names = [self.names[i] for i in ids]
        if self.joined:
            return " ".join(names)
        raw = b"".join(bytes(map(self.byte_of.__getitem__, n)) if all(c in self.byte_of for c in n) else n.encode() for n in names)
        return raw.decode("utf-8", "replace")

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text. Parts between spaces are encoded and decoded once."""
        if self.keep_space or not self.joined:
            found = self.encode(texts.to_pylist())
            return [len(x) for x in found], [sha(" ".join(map(str, x))) for x in found], [sha(self.decode(x)) for x in found]
        parts = pc.split_pattern(pc.replace_substring(pc.cast(texts, pa.large_string()), "\n", " "), " ")
        found = parts.flatten().dictionary_encode()
        distinct, index = found.dictionary.to_pylist(), found.indices.to_numpy()
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > self.most and self.known:
            self.known.clear()
            new = distinct
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            self.known.update((p, (len(x), " ".join(map(str, x)), self.decode(x))) for p, x in zip(some, self.encode(some), strict=True))
        rows = [self.known[p] for p in distinct]
        size = np.fromiter((x[0] for x in rows), np.int64, len(rows))
        index = np.asarray(index)
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        total = np.concatenate([[0], np.cumsum(size[index])])[np.concatenate([[0], ends])]
        some = size[index] > 0
        index, ends = index[some], np.concatenate([[0], np.cumsum(some)])[ends].tolist()
        ids, names = [x[1] for x in rows], [x[2] for x in rows]
        at, a, b = 0, [], []
        for end in ends:
            own = index[at:end].tolist()
            a.append(sha(" ".join([ids[i] for i in own])))
            b.append(sha(" ".join([names[i] for i in own])))
            at = end
        return np.diff(total).tolist(), a, b


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def model(path: str) -> Bpe:
    """One for each worker process, kept between its tasks."""
    return kept(("bpe", path), lambda: Bpe(path))


def digests(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. Nothing is shuffled.

    Null text counts as empty: no tokens, digests of the empty string. Rows with equal or null doc_id each have a row of
    their own; an empty table gives none. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer)
        for batch in bounded(batches, "text"):
            n, a, b = bpe.digests(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
