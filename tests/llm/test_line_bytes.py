"""Words of lines are found in the bytes of many texts, and near lines are one set up to larger groups."""

import random
import time

from levelwise.llm import lines


def test_words_in_bytes_are_the_normalised_words():
    draw = random.Random(1)
    letters = "aAbZ019 \t\n\r\x0b\x1c\x85\xa0　.,-_'ßİẞéÉ今日は𝒳٣５²½क्षไทย\x00\x7f"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(2000)]
    texts += ["", "\n\n", "a" * 200 + " " + "b" * 64 + " " + "b" * 65 + "\n", "abcdefgh abcdefghi", "b" * 65, "٣٣ 12a3"]
    hashes, counts, n_lines = lines.line_words(texts)
    words = [lines.normalised(line) for text in texts for line in text.split("\n")]
    assert n_lines.tolist() == [text.count("\n") + 1 for text in texts]
    assert counts.tolist() == [len(w) for w in words]
    pairs = set(zip([x for w in words for x in w], hashes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    spoken = [tuple(w) for w in words if w]
    pairs = set(zip(spoken, lines.line_numbers(hashes, counts[counts > 0]).tolist()))
    assert len(pairs) == len(set(spoken)) == len({n for _, n in pairs})


def test_forty_near_lines_are_one_set(spark, docs_of, monkeypatch):
    """From 17 lines on they were a set for each window they share."""
    counted, real = {}, lines.stored

    def stored(df, label, **options):
        out = real(df, label, **options)
        counted[label] = out.count()
        return out

    monkeypatch.setattr(lines, "stored", stored)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words[:-1], f"new{chr(97 + i // 26)}{chr(97 + i % 26)}"]) for i in range(40)]
    got = lines.deduplicated_lines(docs_of(list(enumerate(texts)))).collect()
    assert sorted(r.doc_id for r in got if not r.n_removed) == [0]
    assert counted["line-windows"] == 40


def test_equal_ends_are_cut_off_at_once():
    """Every word of an equal end copied both lines."""
    one = list(range(60_000))
    began = time.thread_time()
    assert lines.edit_distance(one, [-1, *one[1:]]) == 1
    assert time.thread_time() - began < 0.5
