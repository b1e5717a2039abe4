"""What line dedup moves and tests grows with lines, not with the windows they share."""

import random
import time

import brute
import numpy as np

from levelwise.llm import lines


def test_a_pair_of_many_windows_is_stored_once(spark, docs_of, monkeypatch):
    """Of 30 words two lines share most windows; they were two rows for each of them."""
    counted, real = {}, lines.stored

    def stored(df, label, **options):
        out = real(df, label, **options)
        counted[label] = out.count()
        return out

    monkeypatch.setattr(lines, "stored", stored)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words), " ".join([*words[:-1], "new"])]
    got = lines.deduplicated_lines(docs_of(list(enumerate(texts)))).collect()
    assert sorted(r.n_removed for r in got) == [0, 1]
    assert counted["line-windows"] == 2


def test_sets_of_windows_are_those_of_close_lines():
    draw = random.Random(6)
    for group in (2, 5, 16, 17, 300):
        members = np.array(draw.sample(range(-1000, 1000), group))
        sketch = {m: draw.choice((4, 5, 20, 30)) | draw.randrange(64) << 12 for m in members.tolist()}
        marks = np.array([sketch[m] for m in members.tolist()], dtype=np.int64)
        near = lambda a, b: lines.close(np.uint64(sketch[a]), np.uint64(sketch[b]))
        links = [(a, b) for a in sketch for b in sketch if a < b and near(a, b)]
        root = brute.union_find(list(sketch), links)
        # The same lines under two keys, and one line alone.
        found, line = lines.window_sets(np.repeat([3, 4, 5], [group, group, 1]), np.r_[members, members, 7], np.r_[marks, marks, 9])
        sets = {}
        for s, x in zip(found.tolist(), line.tolist()):
            sets.setdefault(s, set()).add(x)
        assert all(any(a in own and b in own for own in sets.values()) for a, b in links)
        if group <= lines.SMALL_GROUP:
            want = {m: {x for x in sketch if root[x] == root[m]} for m in sketch}
            assert sets == {min(own): own for own in want.values() if len(own) > 1}
        else:
            assert list(sets.values()) == [{x for link in links for x in link}] * 2


def test_large_groups_of_few_links_are_tested_in_blocks():
    """A line of such a group was compared alone, a call for each: 4,000 lines took seconds."""
    draw = random.Random(5)
    texts = [[f"w{draw.randrange(10**6)}" for _ in range(80)] for _ in range(4000)]
    texts[1::40] = [[*t[:-3], "a", "b", "c"] for t in texts[::40]]
    hashes, counts = lines.word_hashes(texts)
    marks = lines.Sketches(lines.sketches(hashes, counts), lines.wide_sketches(hashes, counts))
    began = time.thread_time()
    blocks = np.arange(len(texts))
    assert lines._connect_blocks(blocks, 0, len(texts), marks)
    took, began = time.thread_time() - began, time.thread_time()
    searched = np.arange(len(texts))
    lines._search(searched, 0, len(texts), marks)
    assert took < time.thread_time() - began
    assert blocks.tolist() == searched.tolist()
    assert (blocks[1::40] == np.arange(0, len(texts), 40)).all()


def test_few_texts_besides_the_wanted_are_fetched(spark):
    """All texts were shuffled for the lines of some."""
    docs = spark.range(20_000).selectExpr("xxhash64(id) as row", "cast(id as string) as whole")
    spots = docs.where("cast(whole as int) % 20 = 0").selectExpr("row as at_row", "array(1) as spots")
    got = {r.whole for r in lines._filtered(docs, spots).collect()}
    assert got >= {str(i) for i in range(0, 20_000, 20)}
    assert len(got) < 1_100


def test_texts_are_joined_alike_at_every_size(docs_of):
    """Small inputs were broadcast, so their figures told nothing of larger ones; large ones were sorted."""
    left = lines.drop_repeats(docs_of([(1, "a b c d\ne f g h"), (2, "a b c d\nx")]))
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
