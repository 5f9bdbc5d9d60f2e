"""Token files, packing and BPE against the tokenizers library itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from ripplegraph.llm import bpe, packing, pieces, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    draw = random.Random(5)
    words = "The quick naïve café ΑΣ ς İstanbul straße 東京 don't we'll 3,14 foo_bar http://a.b/c?d=e 😀 👩‍👩‍👧 á   ᠎   \x1c \x00 <|endoftext|> <|startoftext|> < | > ''' --- \t \n \r\n ﬁ ½".split(" ")
    made = [None, "", " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|> y", " <|startoftext|>z ", "A" * 5000, "ab " * 4000, "é" * 700]
    for _ in range(60):
        made.append(draw.choice(["", " ", "  "]).join(draw.choices(words, k=draw.randint(1, 80))))
    return made + made[5:8]


def encoded(path, end=None):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    found = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts()]
    return [ids if end is None else [*ids, end] for ids in found]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, documents):
    want, at = [], 0
    for i, ids in enumerate(encoded(WORD, 1)):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_files.op4_token_files(spark, documents(texts()), WORD).collect())) == want


def test_token_files_of_no_rows_and_of_null_ids(spark, documents):
    assert token_files.op4_token_files(spark, documents([]), WORD).collect() == []
    found = token_files.op4_token_files(spark, documents(["a", None, "a"], ids=[None, 3, 3]), WORD).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == [(-1, 2), (3, 1), (3, 2)]


def test_bpe_digests(documents):
    tokenizer = Tokenizer.from_file(WORD)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))) for i, ids in enumerate(encoded(WORD))}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(documents(texts()), WORD).collect()}
    assert found == want


def test_bpe_of_no_rows(documents):
    assert bpe.digests(documents([]), WORD).collect() == []


def whole(rows, want):
    """Each id lies in exactly one piece, and sequences have no holes; returns the ids of each sequence's end."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(of) == set(range(len(want)))
    for doc_id, pieces in of.items():
        ids, at = want[doc_id], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    used = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        used.append(at)
    return used


def test_packing(documents):
    want = encoded(BYTE, 0)
    docs = documents(texts())
    used = whole(packing.pack(docs, BYTE).collect(), want)
    assert all(n == 1024 or n & (n - 1) == 0 for n in used)
    used = whole(packing.pack(docs.repartition(7), BYTE, windows=2).collect(), want)
    assert all(n == 1024 or n & (n - 1) == 0 for n in used)


def test_packing_of_no_rows(documents):
    assert packing.pack(documents([]), BYTE).collect() == []


def odd(documents):
    """Null and repeated ids, repeated rows, a text of a million characters, columns that clash with results."""
    long = "naïve words and 東京, " * 50_000
    docs = documents([None, "a b", "a b", long, ""], ids=[None, 3, 3, 7, 8])
    return docs.selectExpr("*", "1 as start", "'x' as n_tokens", "2 as ids", "3 as sequence_id", "'y' as `a b`", "4 as ids_sha256", "5 as merge"), long


def test_token_files_of_odd_rows(spark, documents):
    docs, long = odd(documents)
    rows = sorted((r.doc_id or -1, r.n_tokens) for r in token_files.op4_token_files(spark, docs, WORD).collect())
    n = len(Tokenizer.from_file(WORD).encode(long, add_special_tokens=False).ids)
    assert rows[0] == (-1, 1) and rows[1] == rows[2] and rows[1][0] == 3 and rows[3] == (7, n + 1) and rows[4] == (8, 1)


def test_ranges_of_a_file_that_is_not_local(tmp_path):
    import pyarrow.fs as pafs

    np.arange(1000, dtype="<u2").tofile(tmp_path / "x.ids")
    for fs, path in ((pafs.LocalFileSystem(), str(tmp_path / "x.ids")), (pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), "x.ids")):
        assert token_files.mapped(fs, path, "<u2", 10, 20).tolist() == list(range(10, 20)) and len(token_files.mapped(fs, path, "<u2", 5, 5)) == 0


def test_packing_of_odd_rows(documents):
    docs, long = odd(documents)
    rows = packing.pack(docs, BYTE).collect()
    tokenizer = Tokenizer.from_file(BYTE)
    want = {"a b": len(tokenizer.encode("a b").ids) + 1, long: len(tokenizer.encode(long).ids) + 1, "": 1}
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
    assert dict(total) == {None: 1, 3: 2 * want["a b"], 7: want[long], 8: 1}
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_bpe_of_odd_rows(documents):
    docs, long = odd(documents)
    rows = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs, WORD).collect())
    ids = Tokenizer.from_file(WORD).encode(long, add_special_tokens=False).ids
    assert rows[0] == (-1, 0, hashlib.sha256(b"").hexdigest()) and rows[1] == rows[2] and rows[3] == (7, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_pieces_when_the_store_is_full_and_before_marks():
    draw = random.Random(6)
    parts = [*"abZéß ÀÿIs't.,", "  ", "don't,", "x.", "x..", "é,", "́", "\n", " ,", "'s,", "ſ.", "İ,"]
    given = [t or "" for t in texts()] + ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(400)]
    for path, keep_space in ((WORD, False), (BYTE, True)):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for most in (50, 500, 500_000):
            encoder = pieces.PieceEncoder(path, keep_space, most_pieces=most)
            for at in range(0, len(given), 20):
                ids, bounds = encoder.encode(pa.array(given[at : at + 20]))
                for i, text in enumerate(given[at : at + 20]):
                    assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (path, most, text)
