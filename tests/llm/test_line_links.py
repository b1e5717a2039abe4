"""Lines are linked by edit similarity alone, whatever their fingerprints."""

import random

import brute
from levelwise.llm import lines


def changed(draw, words, edits):
    out = list(words)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"new{draw.randrange(10**6)}"
    return out


def test_similar_lines_are_linked_at_any_fingerprint(spark, docs_of):
    draw = random.Random(9)
    texts = []
    for n in (5, 7, 9, 10, 11, 12, 14, 15, 20, 30, 39, 60, 120):
        for _ in range(6):
            words = [f"w{draw.randrange(4000)}" for _ in range(n)]
            texts.append(" ".join(words))
            texts.append(" ".join(changed(draw, words, n // 5)))
            texts.append(" ".join(words[: n - n // 5]))
            texts.append(" ".join(changed(draw, words, n // 5 + 2)))
    normal = [lines.normalised(t) for t in texts]
    took = [i for i, w in enumerate(normal) if len(w) >= lines.MIN_WORDS]
    edges = [
        (i, j) for i in took for j in took
        if i < j and lines.edit_distance(normal[i], normal[j]) <= 0.2 * max(len(normal[i]), len(normal[j])) + 1e-9
    ]
    assert len(edges) > 150
    root = brute.union_find(took, edges)
    want = {i for i in took if any(root[j] == root[i] for j in took if j < i)}
    got = {r.doc_id for r in lines.deduplicated_lines(docs_of(list(enumerate(texts)))).collect() if r.n_removed}
    assert got == want


def test_short_lines_and_scripts_without_blanks(spark, docs_of):
    same = "今日はとても良い天気ですね"
    near = "今日はとても良い天気ですよ"
    texts = ["Read more\n---\n\nalone", "READ  more!\n---\n\nread less", same, same + "。", near, "昨日は雨でした", "a b c d", "a b c d e"]
    got = {r.doc_id: r.text for r in lines.deduplicated_lines(docs_of(list(enumerate(texts)))).collect()}
    gone = {1: "---\n\nread less", 3: "", 4: "", 7: ""}
    assert got == {i: gone.get(i, t) for i, t in enumerate(texts)}
