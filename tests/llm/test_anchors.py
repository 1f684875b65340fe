"""The two rarest words of each window, against a plain search."""

import numpy as np
import pyarrow as pa
import pytest

from lumachron.llm import decontaminate


@pytest.mark.parametrize("size", [1, 2, 5, 13])
def test_two_rarest_of_each_window(size):
    r = np.random.default_rng(size)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 30, n)) for n in (0, 1, 2, 4, 5, 12, 13, 14, 40, 200)] + [None, "", "one", "!! ,"]
    words = decontaminate.split(pa.array(texts, pa.string()))
    frequency = r.integers(0, 6, len(words.distinct)) * 10**10
    want = set()
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        for start in range(a, max(a + 1, b - size + 1) if b > a else a):
            want |= set(sorted(range(start, min(start + size, b)), key=lambda i: (frequency[words.codes[i]], i))[:2])
    assert decontaminate.anchors(words, frequency, size).tolist() == sorted(want)


def test_nothing_to_test():
    words = decontaminate.split(pa.array([None, ""], pa.string()))
    assert len(decontaminate.anchors(words, np.zeros(0, np.int64), 13)) == 0
