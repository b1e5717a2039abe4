"""Bounds that part lines before a distance is computed never part similar ones."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from levelwise.llm import lines


def marks_of(texts):
    counts = np.array([len(w) for w in texts], dtype=np.int64)
    values = np.array([xxh64_intdigest(x) for w in texts for x in w], dtype=np.uint64)
    return lines.sketches(values, counts), lines.wide_sketches(values, counts)


def test_bounds_hold_for_similar_lines():
    draw = random.Random(3)
    for n in (4, 6, 9, 12, 25, 26, 60, 151, 400):
        for vocabulary in (1, 3, 50, 5000):
            one = [f"w{draw.randrange(vocabulary)}" for _ in range(n)]
            two = list(one)
            for _ in range(n // 5):
                at = draw.randrange(len(two))
                two[at : at + draw.randrange(2)] = [f"w{draw.randrange(vocabulary)}"] * draw.randrange(2)
            if not lines.similar(one, two):
                continue
            sketch, wide = marks_of([one, two])
            assert lines.close(sketch[0], sketch[1])
            assert lines.Sketches(sketch, wide).may_link(np.array([0]), np.array([1])).all()
            assert lines.verified_edges([(1, one), (2, two)]) == [(1, 2)]


def test_rows_with_a_partner():
    draw = random.Random(4)
    for group in (2, 5, 16, 17, 300, 700):
        texts = [[f"w{draw.randrange(9)}" for _ in range(draw.choice((4, 5, 8, 30, 31)))] for _ in range(group)]
        sketch, _ = marks_of(texts)
        keys = np.repeat([7, 9], [1, group - 1]).astype(np.int64)
        want = [
            any(j != i and keys[i] == keys[j] and lines.close(sketch[i], sketch[j]) for j in range(group))
            for i in range(group)
        ]
        assert lines.partnered(keys, sketch).tolist() == want
