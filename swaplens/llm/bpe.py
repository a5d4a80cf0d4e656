"""Byte-level BPE by speculation: a greedy longest match proposes tokens, pair checks verify them, merging mends the rest.

Merging in order of rank gives a sequence of tokens exactly if each token is what its own bytes merge to and no two
neighbours would have merged across their border. A border holds if at no time the last symbol of the left token and the
first symbol of the right one form a pair that merges before either of them grows. All borders of a batch are tested at
once, by undoing the merges of both tokens from the latest on. Words with a border that fails are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaplens.llm.vocabularies import LONGEST, byte_of

#: Fixed value: how byte-level tokenizers part a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = 1 << 40  # the rank of a merge that does not exist
GROUP = 500_000  # characters of texts whose words are proposed and verified together
CACHED = 300_000  # words a worker keeps; about 70 MB


class Merges:
    """A vocabulary and its merges as arrays: `first` and `last` part of each token, and the rank of its merge (-1: none)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or steps.get("type") != "ByteLevel" or not steps.get("use_regex") or steps.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE on plain texts is supported")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) or len(added) > 1:
            raise ValueError("only one added token, taken literally, is supported")
        self.special = {t["content"]: t["id"] for t in added}
        as_byte = byte_of()
        self.vocab = {bytes(map(as_byte.__getitem__, token)): i for token, i in model["vocab"].items() if token not in self.special}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = [self.vocab[bytes([b])] for b in range(256)]
        self.longest = [1] * 256  # length of the longest token that begins with a byte
        for token in self.vocab:
            self.longest[token[0]] = max(self.longest[token[0]], len(token))
        self._merges(model["merges"], as_byte, size)

    def _merges(self, merges: Sequence, as_byte: dict[str, int], size: int) -> None:
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a, b = (np.array([self.vocab[bytes(map(as_byte.__getitem__, p[k]))] for p in parts], np.int64) for k in (0, 1))
        made = np.array([self.vocab[self.bytes_of[x] + self.bytes_of[y]] for x, y in zip(a.tolist(), b.tolist())], np.int64)
        ranks = np.arange(len(parts), dtype=np.int64)
        self.rules = {(x, y): (r, m) for x, y, r, m in zip(a.tolist(), b.tolist(), ranks.tolist(), made.tolist())}
        self.first, self.last, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.first[made], self.last[made], self.rank[made] = a, b, ranks
        keys = (a << 20) | b
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = np.append(keys[order], 1 << 62), np.append(ranks[order], NEVER)
        # a token is what its bytes merge to if both parts are, and nothing merges across them before they do
        sound = (self.rank[a] < ranks) & (self.rank[b] < ranks) & (np.bincount(made, minlength=size)[made] == 1) & self.apart(a, b, whole=False)
        self.sound = np.zeros(size, bool)
        self.sound[self.byte_ids] = True
        for x, y, m, s in zip(a.tolist(), b.tolist(), made.tolist(), sound.tolist()):
            self.sound[m] = s and self.sound[x] and self.sound[y]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NEVER)

    def apart(self, left: np.ndarray, right: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether no merge crosses the border between tokens; without `whole`, the merge of both tokens themselves may.

        Equal merges happen from left to right, so of two at the same rank the one in the left token comes first.
        """
        good = np.ones(len(left), bool)
        at, x, y = np.arange(len(left)), left, right
        till_x, till_y = np.full(len(left), NEVER), np.full(len(left), NEVER)
        tested = whole
        while len(at):
            if tested:
                r = self.rank_of(x, y)
                crossed = (r < till_x) & (r <= till_y) & (r < NEVER)
                good[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            tested = True
            on = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, till_x, till_y = at[on], x[on], y[on], till_x[on], till_y[on]
            later = self.rank[y] >= self.rank[x]  # undo the later merge of the two
            till_x, till_y = np.where(later, till_x, self.rank[x]), np.where(later, self.rank[y], till_y)
            x, y = np.where(later, x, self.last[x]), np.where(later, self.first[y], y)
        return good

    def proposed(self, word: bytes) -> list[int]:
        """The longest token at each place, from left to right."""
        found, at, n, vocab = [], 0, len(word), self.vocab
        while at < n:
            end = min(n, at + self.longest[word[at]])
            while (token := vocab.get(word[at:end])) is None:
                end -= 1
            found.append(token)
            at = end
        return found

    def merged(self, word: bytes) -> list[int]:
        """The exact result of all merges: lowest rank first, then leftmost."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rules, heap = self.rules, []
        for i in range(n - 1):
            if (rule := rules.get((ids[i], ids[i + 1]))) is not None:
                heap.append((rule[0], i, ids[i], ids[i + 1], rule[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has grown since
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rule := rules.get((made, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (rule[0], i, made, ids[after[i]], rule[1]))
            if before[i] >= 0 and (rule := rules.get((ids[before[i]], made))) is not None:
                heapq.heappush(heap, (rule[0], before[i], ids[before[i]], made, rule[1]))
        return [i for i in ids if i >= 0]

    def words(self, words: Sequence[bytes]) -> tuple[list[list[int]], int]:
        """The tokens of each word, and how many words had to be merged."""
        found = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for ts in found for t in ts), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        wrong = owner[~self.sound[flat]]
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        pairs, which = np.unique((flat[inner] << 20) | flat[inner + 1], return_inverse=True)
        good = self.apart(pairs >> 20, pairs & 0xFFFFF)
        failed = np.unique(np.concatenate([wrong, owner[inner[~good[which]]]])).tolist()
        for k in failed:
            found[k] = self.merged(words[k])
        return found, len(failed)


class Coder:
    """Packed ids (little-endian unsigned 32-bit) of whole texts and texts of packed ids, equal to the library's."""

    def __init__(self, path: str, cached: int = CACHED):
        import regex

        self.merges, self.cached = Merges(path), cached
        self.split = regex.compile(WORD).findall
        self.known: dict[str, bytes] = {}
        (self.mark, end), = self.merges.special.items() or [(None, 0)]
        self.mark_ids = end.to_bytes(4, "little")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The packed ids of each text; words that are new to the cache are proposed and verified together."""
        split, known = self.split, self.known
        parts = [[split(p) for p in (t.split(self.mark) if self.mark else [t])] for t in texts]
        new = [w for w in set().union(*(p for ps in parts for p in ps)) if w not in known]
        found, _ = self.merges.words([w.encode() for w in new])
        known.update(zip(new, (array("I", ids).tobytes() for ids in found)))
        out = [self.mark_ids.join([b"".join(map(known.__getitem__, p)) for p in ps]) for ps in parts]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > self.cached:  # what came first is what is frequent
            for w in list(known)[self.cached // 2 :]:
                del known[w]
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.merges.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The one of this worker; its cache outlives the task."""
    return Coder(path)


def groups(texts: Sequence[str], most: int = GROUP) -> Iterator[Sequence[str]]:
    """Consecutive texts of at most `most` characters together; a longer text comes alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def encoded(text: Column, tokenizer: str) -> Column:
    """Packed ids (binary, little-endian unsigned 32-bit) of a text column; null counts as empty."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(tokenizer)
        for batch in batches:
            yield pa.array([ids for group in groups(batch.to_pylist()) for ids in c.encode(group)], pa.binary())

    return encode(F.coalesce(text.cast("string"), F.lit("")))


def decoded(ids: Column, tokenizer: str) -> Column:
    """The text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null counts as empty."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(tokenizer)
        for batch in batches:
            yield pa.array([c.decode(ids) for ids in batch.to_pylist()], pa.string())

    return decode(F.coalesce(ids, F.lit(b"")))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, ids (packed), decoded (the text that these ids stand for).

    A null text is empty and has no ids. Null ids of rows stay null, repeated rows are encoded each, very long texts
    whole; a string of the special token inside a text is that token. No rows give no rows. Further columns are not read.
    """
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            for rows in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ids = [i for group in groups(rows.column(1).to_pylist()) for i in c.encode(group)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], schema=schema)

    rows = docs.select(docs[id_col].cast("long").alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(both, f"`{id_col}` long, ids binary, decoded string")  # one worker a task for both directions
