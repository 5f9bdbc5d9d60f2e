r"""Language identification by cross-parsing entropy.

Learning: for each language a bounded sample of labelled text, lower-cased, each run of other characters than letters
one space, makes a suffix automaton, which recognises exactly the sample's substrings. Prediction: a text is parsed from
left to right into the longest phrases that occur in a language's sample; few long phrases mean that the sample
predicts the text. phrases * log2(sample length) / text length estimates the cross entropy; the least wins, ties go to
the smaller name. All segments of a batch walk all automata in lockstep, one array operation a character.

Bounds of what is learnt from (parameters): `docs_per_language` documents, taken in the order of a hash of doc_id,
`chars_per_doc` characters of each, `sample_chars` of a language and `all_chars` of all languages, shared out evenly. More than
`most_languages` labels are an error, as such a column doesn't hold languages. Prediction reads whole texts, in segments of
1,024 symbols that are parsed each for itself.

`und`, score 0: text is null or has no letter, or there is nothing to learn from. Score: 1 - least / second least
entropy (1 with one language). Every letter of the samples is kept: transitions by the commonest DENSE_LETTERS stand in a
table, those by rarer ones (of many scripts, or Chinese) in a sorted list of keys. Letters unknown to all samples are
phrases of their own. Rows with null doc_id are predicted, never learnt from, and not held out. Repeated rows are predicted alike. An empty table gives no rows. Other
columns are not read, whatever their names; accepted() passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, kept

UND = "und"
SEGMENT = 1024
DENSE_LETTERS = 126


def suffix_automaton(symbols: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the automaton of all substrings: [state, symbol] -> state, 0 for none; state 1 is the start.

    Those by symbols from width - 1 on are rows (state, symbol, to) of the second array.

    Blumer et al. (1985): each symbol adds a state for the whole prefix, and splits a state whose substrings no longer
    end at the same places.
    """
    step: list[dict[int, int]] = [{}, {}]
    link, long = [0, 0], [-1, 0]
    last = 1
    for c in symbols:
        now = len(step)
        step.append({})
        long.append(long[last] + 1)
        link.append(1)
        at = last
        while at and c not in step[at]:
            step[at][c] = now
            at = link[at]
        if at:
            to = step[at][c]
            if long[to] == long[at] + 1:
                link[now] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                long.append(long[at] + 1)
                link.append(link[to])
                while at and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    table, rare = np.zeros((len(step), width), np.int32), []
    for state, out in enumerate(step):
        for c, to in out.items():
            if c < width - 1:
                table[state, c] = to
            else:
                rare.append((state, c, to))
    return table, np.array(rare, np.int64).reshape(-1, 3)


class Model:
    """samples: (language, text) pairs, one for each language."""

    def __init__(self, samples: list[tuple[str, str]]):
        samples = sorted((name, text) for name, text in samples if any(c.isalpha() for c in text))
        self.names = [n for n, _ in samples]
        letters = sorted({c for _, t in samples for c in t.lower() if c.isalpha()}, key=lambda c: (-sum(t.count(c) for _, t in samples), c))
        self.width = min(len(letters), DENSE_LETTERS) + 2
        self.unknown = len(letters) + 1
        self.symbol = np.zeros(0x110000, np.min_scalar_type(self.unknown))
        self.symbol[[i for i in range(0x110000) if chr(i).isalpha()]] = self.unknown
        for i, c in enumerate(letters):
            for x in {c, c.upper(), c.title()}:
                if len(x) == 1:
                    self.symbol[ord(x)] = i + 1
        tables, at = [np.zeros(self.width, np.int32)], self.width
        self.start, size, keys, ends = [], [], [], []
        for _, text in samples:
            symbols = self.symbols(text)
            own, rare = suffix_automaton([s for s in symbols.tolist() if s < self.unknown], self.width)
            keys.append((at + rare[:, 0] * self.width) * (self.unknown + 1) + rare[:, 1])
            ends.append(at + rare[:, 2] * self.width)
            self.start.append(at + self.width)
            tables.append(np.where(own, at + own * self.width, 0).astype(np.int32).ravel())
            at += own.size
            size.append(max(2, len(symbols)))
        self.table = np.concatenate(tables)
        # sorted, as offsets rise; the last stands for none
        keys, ends = np.concatenate([*keys, [np.iinfo(np.int64).max]]), np.concatenate([*ends, [0]]).astype(np.int32)
        order = np.argsort(keys)
        self.keys, self.ends = keys[order], ends[order]
        self.bits = np.log2(np.array(size, float))
        first = np.array(self.start, np.int64)[:, None]
        self.again = self.step(np.repeat(first, self.unknown + 1, 1), np.arange(self.unknown + 1)) if samples else np.zeros((0, self.unknown + 1), np.int32)
        self.again = np.where(self.again, self.again, first).astype(np.int32) if samples else self.again

    def step(self, state: np.ndarray, now: np.ndarray) -> np.ndarray:
        """[language, segment]: where the segments' symbols lead, 0 for nowhere."""
        if self.unknown < self.width:
            return self.table[state + now]
        to = self.table[state + np.minimum(now, self.width - 1).astype(np.int32)]
        if len(rare := np.flatnonzero((now >= self.width - 1) & (now < self.unknown))):
            wanted = state[:, rare].astype(np.int64) * (self.unknown + 1) + now[rare].astype(np.int64)
            found = np.searchsorted(self.keys, wanted)
            to[:, rare] = np.where(self.keys[found] == wanted, self.ends[found], 0)
        return to

    def symbols(self, text: str) -> np.ndarray:
        found = self.symbol[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not len(found):
            return found
        keep = found != 0
        keep[1:] |= found[:-1] != 0
        return found[keep]

    def taught(self, text: str, most_unknown: float) -> bool:
        """Whether text has letters, and at most this share of them are unknown."""
        count = np.bincount(self.symbols(text), minlength=self.unknown + 1)
        letters = int(count[1:].sum())
        return letters > 0 and (not self.names or count[self.unknown] <= most_unknown * letters)

    def phrases(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """[language, segment]: phrases of each segment; segments are in descending order of length."""
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(start), 1)
        count = np.ones(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
        for t, m in enumerate(active.tolist()):
            now = symbols[start[:m] + t]
            to = self.step(state[:, :m], now)
            dead = to == 0
            count[:, :m] += dead
            np.copyto(to, self.again[:, now], where=dead)
            state[:, :m] = to
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parts = [self.symbols(t or "") for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        lettered = np.fromiter((bool(p.any()) for p in parts), bool, len(parts))
        if not self.names or not lettered.any():
            return [UND] * len(texts), [0.0] * len(texts)
        flat = np.concatenate(parts)
        first = np.cumsum(size) - size
        pieces = np.where(lettered, -(-size // SEGMENT), 0)
        owner = np.repeat(np.arange(len(parts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(SEGMENT, size[owner] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        count = self.phrases(flat, (first[owner] + nth * SEGMENT)[order], length[order])
        total = np.stack([np.bincount(owner[order], c, len(parts)) for c in count])
        entropy = total * self.bits[:, None] / np.maximum(size, 1)
        best = entropy.argmin(0)
        ranked = np.sort(entropy, 0)
        score = np.clip(1 - ranked[0] / np.maximum(ranked[1], 1e-12), 0, 1) if len(ranked) > 1 else np.ones(len(parts))
        return [self.names[b] if x else UND for b, x in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0).tolist()


def held_out(id_column: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", docs_per_language: int = 64, chars_per_doc: int = 1500, sample_chars: int = 50_000, all_chars: int = 200_000, most_languages: int = 256) -> list[tuple[str, str]]:
    """Each language's sample. Ids are ranked without their texts; then the ranked ids' texts are fetched.

    The driver receives docs_per_language * chars_per_doc characters a language at most.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang", F.row_number().over(order).alias("nth")).where(F.col("nth") <= docs_per_language)
    ranked = chosen.limit(docs_per_language * most_languages + 1).toArrow()
    languages = set(ranked.column("lang").to_pylist())
    if len(languages) > most_languages or ranked.num_rows > docs_per_language * most_languages:
        raise ValueError(f"{label_column} holds more than {most_languages} languages")
    if not languages:
        return []
    ids: dict = {}
    for doc_id, lang, nth in sorted(zip(*(ranked.column(c).to_pylist() for c in ("doc_id", "lang", "nth")), strict=True), key=lambda r: (r[2], r[1], r[0])):
        ids.setdefault(doc_id, (nth, lang))
    bounded_ids = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(list(ids), ranked.schema.field("doc_id").type)}))
    texts = rows.join(F.broadcast(bounded_ids), "doc_id").select("doc_id", "lang", F.substring("text", 1, chars_per_doc).alias("text")).distinct()
    samples: dict[str, str] = {}
    size = min(sample_chars, all_chars // len(languages))
    for r in sorted(texts.collect(), key=lambda r: (ids[r["doc_id"]], r["lang"], r["text"])):
        samples[r["lang"]] = (samples.get(r["lang"], "") + " " + r["text"])[:size]
    return sorted(samples.items())


def model(samples: list[tuple[str, str]]) -> Model:
    """One for each worker process, kept between its tasks."""
    return kept(("language", tuple(samples)), lambda: Model(samples))


def identify(docs: DataFrame, samples: list[tuple[str, str]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(samples)
        for batch in bounded(batches, "text"):
            lang, score = known.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, samples: list[tuple[str, str]], text_column: str = "text", label_column: str = "lang", most_unknown: float = 0.5) -> DataFrame:
    """The rows of docs, columns as they are, whose text has a taught language; the label column, if there is one, holds it.

    Goes: text that is null or has no letter, and text more than most_unknown of whose letters no language's sample holds,
    as it is of another script. With nothing learnt only the former goes, and labels stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(samples)
        for batch in bounded(batches, text_column):
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            if label_column in batch.schema.names and samples:
                at = batch.schema.get_field_index(label_column)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(known.predict(texts)[0], batch.schema.types[at]))
            yield batch.filter(pa.array([known.taught(t or "", most_unknown) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
