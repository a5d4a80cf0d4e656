"""Token ids of public tokenizers, by worker caches of the pieces between which no token reaches."""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the code points that Unicode calls white space.
WHITE = "\t-\r \x85\xa0  -     　"

CACHED = 700_000  # pieces a worker keeps; about 150 MB
LONGEST = 64  # longer pieces are encoded and not kept
GROUP = 1_500_000  # code points of texts whose words are looked up together


#: A word of Latin letters and the stop after it: no token spans both, and each letter has one lower-case letter.
STOPPED = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


#: A word of Latin letters and the signs after it, but for those of contractions and special tokens: no token spans both.
ENDED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")

#: Lower-case letters that normalizers leave as they are; a word of them is one piece of a text.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def byte_of() -> dict[str, int]:
    """The byte for each character in which byte-level vocabularies are written: itself if it prints, else 256 and on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def drops_white_space(tokenizer) -> bool:
    """Whether white space gives no token and no piece spans it, so that words can be encoded one by one."""
    spec = json.loads(tokenizer.to_str())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
    kept = steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    return bool(kept and steps[0]["pattern"].get("Regex", r"\s").replace(r"[^\s", "").count(r"\s") == 0 and normal <= {"NFC", "Replace", "Lowercase"})


class Known(dict):
    """A worker's cache of pieces, which encodes a piece when it is first asked for.

    Words that differ by a stop (or by case, if `lower`) are encoded once. Pieces beyond LONGEST are not kept. When the
    cache is full, `trim` keeps what came first, which is what is frequent, and forgets the later half.
    """

    def __init__(self, encode, lower: bool, first=()):
        super().__init__(first)
        self.encode, self.lower = encode, lower

    def __missing__(self, piece: str):
        m = STOPPED.fullmatch(piece)
        word, stop = (m[1].lower() if self.lower else m[1], m[2]) if m else (piece, "")
        if word != piece:
            value = self[word] + self[stop] if stop else self[word]
        else:
            value = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = value
        return value

    def trim(self, limit: int) -> None:
        if len(self) > limit:
            first = list(islice(self.items(), limit // 2))
            self.clear()
            self.update(first)


@lru_cache(maxsize=2)
def word_encoder(path: str, cached: int = CACHED) -> WordEncoder:
    """The one of this worker: its cache outlives the task, so that later tasks encode only words that are new to it."""
    return WordEncoder(path, cached)


class WordEncoder:
    """Packed ids (little-endian unsigned 32-bit) of whole texts, equal to the library's without added tokens.

    Texts are encoded in groups: each distinct word of a group is looked up once, and the ids are gathered by place.
    Two caches are kept, of words and of forms (a word with a stop or in capitals); only a word that is new is merged.
    """

    def __init__(self, path: str, cached: int = CACHED):
        self.tokenizer, self.cached = load(path), cached
        self.by_word = drops_white_space(self.tokenizer)
        self.known = Known(self.piece, True, {"": b""})
        self.forms: dict[str, bytes] = {}
        char = {b: c for c, b in byte_of().items()}
        self.characters = "".join(map(char.__getitem__, range(256)))
        self.tokenize = self.tokenizer.model.tokenize
        # a plain word needs the merges only, if the tokenizer does with it what byte-level ones do
        self.plain = all(self.merged(w) == self.encode(w) for w in ("the", "zürich", "straße", "naïveté", "ÿæøð", "qxzvw"))

    def merged(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(charmap_decode(word.encode(), "strict", self.characters)[0])]).tobytes()

    def piece(self, word: str) -> bytes:
        return self.merged(word) if self.plain and PLAIN.fullmatch(word) else self.encode(word)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def form(self, text: str) -> bytes:
        """The ids of what stands between spaces."""
        m = ENDED.fullmatch(text)
        if not m:
            return self.known[text]
        word = m[1].lower()
        ids = self.known.get(word)
        if ids is None:
            ids = self.merged(word) if self.plain else self.encode(word)
            if len(word) <= LONGEST:
                self.known[word] = ids
        if m[2]:
            ids += self.known[m[2]]
        if len(text) <= LONGEST and text != word:
            self.forms[text] = ids
        return ids

    def group(self, texts: list[str]) -> Iterator[bytes]:
        words = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        at, form, forms, known = coded.indices.to_numpy(), self.form, self.forms.get, self.known.get
        found = [v if (v := known(w)) is not None or (v := forms(w)) is not None else form(w) for w in pc.binary_join(distinct, " ")[0].as_py().split(" ")]
        ids = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, mine = np.cumsum(size) - size, size[at]
        ends = np.concatenate([[0], np.cumsum(mine)])
        packed = memoryview(ids[np.repeat(first[at] - ends[:-1], mine) + np.arange(ends[-1])].tobytes())
        bounds = (4 * ends[words.offsets.to_numpy() - words.offsets[0].as_py()]).tolist()
        self.known.trim(self.cached)
        if len(self.forms) > self.cached // 2:
            self.forms = dict(islice(self.forms.items(), self.cached // 4))
        return (bytes(packed[a:b]) for a, b in zip(bounds, bounds[1:]))

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from map(self.encode, texts)
            return
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self.group(held)
                held, size = [], 0
        if held:
            yield from self.group(held)
