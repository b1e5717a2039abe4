"""Candidates are verified in sets that do not grow along chains of windows."""

import random

import brute
import numpy as np

from levelwise.llm import lines


def sets_of(rows, sketch):
    rows = sorted(rows)
    keys, members = (np.array(x, dtype=np.int64) for x in zip(*rows))
    marks = np.array([sketch[m] for m in members.tolist()], dtype=np.uint64)
    wide = np.array([b""] * len(rows), dtype=object)
    found, line = lines.candidate_sets(keys, members, marks, wide)
    return sorted(zip(found.tolist(), line.tolist()))


def test_a_chain_of_candidates_is_not_one_set():
    chain = [(k, line) for k in range(30) for line in (k, k + 1)]
    found = sets_of(chain, [20] * 31)
    assert found == sorted((k, line) for k, line in chain)
    # Two windows of the same lines give one set, a line alone none.
    assert sets_of([(1, 5), (1, 6), (2, 5), (2, 6), (3, 7)], {5: 20, 6: 20, 7: 20}) == [(5, 5), (5, 6)]
    assert sets_of([(1, 5), (2, 6)], {5: 20, 6: 20}) == []


def test_sets_connect_all_pairs_of_a_key_that_may_link():
    draw = random.Random(8)
    for group in (2, 5, 16, 17, 60):
        members = draw.sample(range(-1000, 1000), group)
        sketch = {m: draw.choice((4, 5, 20, 30)) | draw.randrange(64) << 12 for m in members}
        near = lambda a, b: lines.close(np.uint64(sketch[a]), np.uint64(sketch[b]))
        root = brute.union_find(members, [(a, b) for a in members for b in members if a < b and near(a, b)])
        least = {m: min(x for x in members if root[x] == root[m]) for m in members}
        want = sorted((least[m], m) for m in members if sum(root[x] == root[m] for x in members) > 1)
        assert sets_of([(3, m) for m in members], sketch) == want


def test_large_sets_are_verified_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(lines, "VERIFY_ROWS", 4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[:i] + [f"new{i}"] + words[i + 1 :]) for i in range(30)]
    got = lines.deduplicated_lines(docs_of(list(enumerate(texts)))).collect()
    assert sorted(r.doc_id for r in got if not r.n_removed) == [0]


def test_texts_go_through_the_last_join_once(docs_of):
    left = lines.drop_repeats(docs_of([(1, "a b c d\ne f g h"), (2, "a b c d\nx"), (3, None), (3, "")]))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "whole#" not in plan.split("LeftOuter")[1].split("\n", 1)[1]
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in left.collect()) == [
        (1, "a b c d\ne f g h", False), (2, "x", False), (3, "", False), (3, "", True),
    ]
