"""Longest verbatim matches with the benchmark: brute force, and windows that very many items share."""
import random
import time

import pytest

from swaplens.llm import decontamination as D


def brute_longest(text, items, window):
    words, best = D.words_of(text), 0
    for _, item in items:
        other = D.words_of(item)
        least = min(window, len(other))
        for i in range(len(words)):
            for j in range(len(other) - least + 1 if least else 0):
                k = 0
                while i + k < len(words) and j + k < len(other) and words[i + k] == other[j + k]:
                    k += 1
                best = max(best, k if k >= least else 0)
    return best


@pytest.mark.parametrize("window", [1, 3, 5, 10])
def test_longest_matches(window):
    r = random.Random(window)
    for _ in range(25):
        items = [(f"i{k}", " ".join(r.choices("abc", k=r.choice([0, 2, 5, 12, 30])))) for k in range(6)]
        texts = [" ".join(r.choices("abcx", weights=[9, 9, 9, 1], k=r.choice([0, 3, 40, 90]))) for _ in range(5)]
        assert [f["longest"] for f in D.search(texts, D.Benchmark(items, window))] == [brute_longest(t, items, window) for t in texts]


def test_items_with_one_opening_cost_no_pass_each():
    opening = " ".join(f"p{k}" for k in range(10))
    bench = D.Benchmark([(f"i{k:04}", f"{opening} q{k} a b c d e f g h i j k{k % 7}") for k in range(4000)], 10)
    start = time.perf_counter()
    found = D.search([f"{opening} q{k} a b c" for k in range(20)], bench)
    assert time.perf_counter() - start < 10  # one pass for each item takes over a minute
    assert all(len(f["items"]) == 4000 and f["longest"] == 14 for f in found)


def test_no_items():
    assert [f["longest"] for f in D.search(["a b c", ""], D.Benchmark([], 10))] == [0, 0]
    assert [f["n_hit"] for f in D.search(["a b c", ""], D.Benchmark([("i", "")], 10))] == [0, 0]
