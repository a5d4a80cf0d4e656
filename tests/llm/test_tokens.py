"""Packing, counts and files of tokens, against the library on whole texts."""
import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from swaplens.llm import packing, token_counts, token_files
from swaplens.llm import vocabularies as V

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(array("I", values).tobytes())


def test_pieces_encode_as_whole_texts_do():
    r = random.Random(3)
    letters = [*"aAbZéÉüß.,,  \n\t'!?-_019\x1c\x85\xa0́Σςσİ漢字½²٣ſK", "'s", "'ll", "<|endoftext|>", "the", "  ", "\n\n"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(3000)]
    words, known = V.WordEncoder(WORD), V.Known(lambda p: len(ids_of.encode(p, add_special_tokens=False)), False)
    ids_of = Tokenizer.from_file(BYTE)
    assert words.by_word
    library = Tokenizer.from_file(WORD)
    for text, packed in zip(texts, words(texts)):
        assert packed == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text
        assert sum(map(known.__getitem__, token_counts.PIECE.findall(text))) == len(ids_of.encode(text, add_special_tokens=False)), text


def test_a_full_cache_forgets_what_came_late():
    known = V.Known(len, False)
    for k in range(10):
        known[f"w{k}"]
    known.trim(8)
    assert list(known) == ["w0", "w1", "w2", "w3"] and known["w9"] == 2
    known["x" * 100]
    assert "x" * 100 not in known


def test_counts(odd, odd_rows, empty):
    got = Counter(tuple(r) for r in token_counts.count_tokens(odd, BYTE, limit=50, table_size=40).collect())
    want = Counter((i, len((t or "").encode()), n := len(ids(BYTE, t)), n > 50) for i, t, *_ in odd_rows)
    assert got == want
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_counts_leave_what_the_table_missed_in_the_worker(spark, odd):
    token_counts.count_tokens(odd, BYTE, table_size=1).collect()

    def kept(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [len(token_counts._lengths(BYTE))] * batch.num_rows})

    assert spark.range(64, numPartitions=32).mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] > 0


@pytest.mark.parametrize("size", [16, 4096])
def test_packing(odd, odd_rows, empty, size):
    rows = packing.pack(odd, WORD, size=size, end_id=1, keep_ids=True).collect()
    want = Counter()
    for i, t, *_ in odd_rows:
        own = [*ids(WORD, t), 1]
        want.update((i, k, at, len(own[at : at + size]), crc(own[at : at + size])) for k, at in enumerate(range(0, len(own), size)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // size) + 2
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_and_are_near_the_bound(seed):
    r = random.Random(seed)
    size = 64
    counts = {n: r.randint(1, 400) for n in r.sample(range(1, size + 1), r.randint(1, 40))}
    chosen = packing.plan(counts, size)
    held = Counter()
    for pattern, times in chosen:
        assert sum(n * k for n, k in pattern) <= size and times > 0
        for n, k in pattern:
            held[n] += k * times
    assert held == Counter(counts)
    used = sum(times for _, times in chosen)
    large = sum(c for n, c in counts.items() if 2 * n > size)
    bound = max(large, -(-sum(n * c for n, c in counts.items()) // size))
    assert used <= sum(times for _, times in packing.best_fit(counts, size)) + 3
    assert used <= 1.25 * bound + 3


def test_files(spark, odd, odd_rows, empty):
    got = sorted(map(tuple, token_files.round_trip(odd, WORD).collect()), key=lambda r: r[1])
    order = sorted(((i, t or "") for i, t, *_ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, before = [], 0
    for i, t in order:
        own = [*ids(WORD, t), 2]
        want.append((i, before, len(own), crc(own)))
        before += len(own)
    assert got == want
    assert token_files.round_trip(empty, WORD).count() == 0


def test_files_skip_by_id(spark, odd, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write(odd, path, WORD)
    assert token_files.read(spark, path).filter("doc_id = 5").count() == 1
    import pyarrow.orc as orc

    files = sorted(tmp_path.glob("tokens/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == odd.count()
    plan = token_files.read(spark, path).filter("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan
