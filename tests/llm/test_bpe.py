"""Speculated and verified BPE against the library, on whole texts, and its decoding."""
import json
import random
from array import array
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from swaplens.llm import bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(BYTE)


def packed(ids):
    return array("I", ids).tobytes()


def test_round_trip_of_odd_rows(odd, odd_rows, empty, library):
    got = Counter(tuple(r) for r in bpe.round_trip(odd, BYTE).collect())
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in odd_rows}
    want = Counter((i, packed(ids[t]), library.decode(ids[t], skip_special_tokens=False)) for i, t, *_ in odd_rows)
    assert Counter((i, bytes(b), d) for (i, b, d), n in got.items() for _ in range(n)) == want
    assert bpe.round_trip(empty, BYTE).count() == 0


def test_words_of_every_kind(coder, library):
    r = random.Random(5)
    letters = [*"aAbeZéÉüß.,,  \n\t'!?-_019\x1c\x85\xa0́Σςσİ漢字½²٣ſK", "'s", "'ll", "<|endoftext|>", "<|endof", "the", "tion", "  ", "\n\n", "😀"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)] + ["a" * 30_000, "ab" * 9_000 + "c", " " * 5000, "é" * 4000]
    for group in bpe.groups(texts, 5000):
        for text, got, want in zip(group, coder.encode(group), library.encode_batch(list(group), add_special_tokens=False)):
            assert got == packed(want.ids), text[:80]
            assert coder.decode(got) == library.decode(want.ids, skip_special_tokens=False) == text


def test_proposals_that_fail_are_merged_and_others_stand(coder):
    r = random.Random(6)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 12))).encode() for _ in range(4000)]
    found, failed = coder.merges.words(words)
    merged = [coder.merges.merged(w) for w in words]
    assert found == merged
    assert failed == sum(coder.merges.proposed(w) != m for w, m in zip(words, merged)) and 0 < failed < len(words)


def test_a_border_holds_exactly_if_both_tokens_stay(coder):
    m = coder.merges
    r = random.Random(7)
    import numpy as np

    a, b = (np.array(r.choices(range(50_256), k=5000)) for _ in range(2))
    good = m.apart(a, b) & m.sound[a] & m.sound[b]
    for x, y, g in zip(a.tolist(), b.tolist(), good.tolist()):
        assert g == (m.merged(m.bytes_of[x] + m.bytes_of[y]) == [x, y])


def test_decoding_of_any_ids(coder, library):
    ids = random.Random(8).choices(range(50_257), k=5000)  # parts of characters, and the special token
    assert coder.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_a_small_cache_gives_the_same(library):
    small = bpe.Coder(BYTE, cached=10)
    texts = [f"word{k} of {k % 7} some others" for k in range(60)]
    assert [small.encode([t])[0] for t in texts] == [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(small.known) <= 10


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    for path in (tmp_path / "t.json", public_tokenizers.path("word_bpe_49k.json")):
        with pytest.raises(ValueError):
            bpe.Coder(str(path))
