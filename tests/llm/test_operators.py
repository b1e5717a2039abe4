"""Every query of the package against a plain re-computation, on whole tables."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from checking import connect, differences
from levelwise.llm import chat, components, lines, oracle, packing, pii, queries, quality, simhash

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [
        (r.doc_id, r.text)
        for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    ]


def rows_of(spark, name, folder=SMALL):
    return queries.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_sql(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert differences(df, connect(data), oracle.ORACLE_SQL[name]) == []


def test_quality(spark, small):
    got = {r.doc_id: r for r in rows_of(spark, "op2_quality_rules")}
    assert len(got) == len(small)
    for doc, text in small:
        r = got[doc]
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (*counts, r.base_failed) == brute.base_counts(text), doc
        assert not (r.base_failed and r.kept)


def test_passages(spark, small):
    got = sorted(((r.doc_id, r.start, r.end) for r in rows_of(spark, "op3_repeated_passages")), key=str)
    assert got == brute.passages(small)


def test_contamination(spark, small):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = brute.contamination(small, [(r.item_id, r.text) for r in items])
    got = [tuple(r) for r in rows_of(spark, "op4_decontamination")]
    assert sorted(got) == sorted(want)
    assert any(r[-1] for r in want)


def test_personal_data(spark, small):
    got = {r.doc_id: r for r in rows_of(spark, "op5_personal_data")}
    for doc, text in small:
        want = brute.personal(text)
        spans = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        r = got[doc]
        kinds = [kind for *_, kind in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in brute.PATTERNS]
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))


def test_sharding(spark, small):
    got = rows_of(spark, "op6_sharding")
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(small, key=lambda d: (hashlib.md5((d[1] or "").encode()).hexdigest(), d[0]))
    total, ahead, slots = sum(size(t) for _, t in small), 0, [0] * 40
    want = []
    for doc, text in order:
        shard = min((2 * ahead + size(text)) * 40 // (2 * total), 39)
        want.append((doc, size(text), zlib.crc32((text or "").encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        ahead += size(text)
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines(spark, small):
    """All pairs of distinct lines, compared by edit similarity."""
    import numpy as np

    place, own = {}, {}
    for doc, text in small:
        for n, line in enumerate((text or "").split("\n")):
            w = lines.normalised(line)
            if len(w) >= lines.MIN_WORDS:
                own[doc, n] = " ".join(w)
                place.setdefault(own[doc, n], w)
    # A word of the longer line without a partner in the other costs an edit, so two lines are no nearer
    # than these are many. A pair that this bound parts needs no distance; every pair is looked at.
    keys = sorted(place, key=lambda k: len(place[k]))
    sizes = np.array([len(place[k]) for k in keys])
    spots = {}
    for i, k in enumerate(keys):
        for w, n in Counter(place[k]).items():
            spots.setdefault(w, []).append((i, n))
    spots = {w: np.array(x).T for w, x in spots.items()}
    edges = []
    for i, k in enumerate(keys):
        allowed = 0.2 * np.maximum(sizes, sizes[i]) + 1e-9
        shared = np.zeros(len(keys), dtype=np.int64)
        for w, n in Counter(place[k]).items():
            at, counts = spots[w]
            shared[at] += np.minimum(counts, n)
        least = np.maximum(sizes, sizes[i]) - shared
        for j in np.flatnonzero(least <= allowed):
            if j > i and plain_distance(place[k], place[keys[j]]) <= allowed[j]:
                edges.append((k, keys[j]))
    root = brute.union_find(keys, edges)
    seen, want = set(), {}
    for doc, text in sorted(small):
        kept = []
        for n, line in enumerate((text or "").split("\n")):
            group = root[own[doc, n]] if (doc, n) in own else None
            if group is None or group not in seen:
                kept.append(line)
            if group is not None:
                seen.add(group)
        want[doc] = "\n".join(kept)
    got = {r.doc_id: r.text for r in rows_of(spark, "op7_line_dedup")}
    assert {d for d in want if want[d] != got[d]} == set()


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_edit_distance():
    draw = random.Random(5)
    for _ in range(400):
        a, b = ([draw.choice("abc") for _ in range(draw.randrange(12))] for _ in range(2))
        assert lines.edit_distance(a, b) == plain_distance(a, b)


def test_chat(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    talks = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in rows_of(spark, "op8_chat")}
    assert set(got) == set(talks)
    for conv, talk in talks.items():
        r = got[conv]
        loss = "".join(t for role, t in talk if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in talk)
        assert (r.n_turns, r.loss_chars) == (len(talk), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_template_language():
    scope = {"messages": [{"role": "user", "text": "a<b"}, {"role": "x", "text": None}], "v": 2}
    render = lambda s: "".join(t for t, _ in chat.compile_template(s)(scope))
    assert render("{# no #}{{ 'a' + 'b' | upper }}{{ 1 + 2 }}") == "aB3"
    assert render("{% for m in messages %}{{ loop.index }}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}") == "0a<b,1"
    assert render("{% if v == 1 %}one{% elif v == 2 and true %}two{% else %}more{% endif %}") == "two"
    assert chat.simplify(chat.parse("a{% if 1 == 1 %}b{{ 'c' }}{% else %}{{ v }}{% endif %}d")) == [("text", "abcd")]
    marks = list(chat.compile_template("{% generation %}{{ v }}{% endgeneration %}.")(scope))
    assert marks == [("2", True), (".", False)]
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{{ x | exec }}", "{% endfor %}", "{{ }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for text in ("", "\\", "\\l<#\n\\n", "plain"):
        assert chat.unescape(chat.escape(text)) == text


def test_near_duplicates(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute.fingerprint(r.text) for r in docs}
    root = brute.near(prints.values(), 4)
    least = {}
    for doc, p in prints.items():
        least[root[p]] = min(doc, least.get(root[p], doc))
    want = sorted((d, f"{p:016x}", least[root[p]]) for d, p in prints.items())
    assert sorted(map(tuple, rows_of(spark, "op9_near_duplicates", data))) == want


def test_probes_find_every_pair():
    import numpy as np

    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = [base]
    for _ in range(5):
        near = base.copy()
        for _ in range(4):
            near ^= np.uint64(1) << draw.integers(0, 64, len(near), dtype=np.uint64)
        flips.append(near)
    prints = np.unique(np.concatenate(flips))
    for population in (1000, 10**6, 10**10):
        parts = simhash.plan_probes(prints, population, 4)
        assert sum(t + 1 for _, t in parts) == 5
        plan = [[b for b in p if b not in out] for p, t in parts for out in simhash.combinations(p, t)]
        met = set()
        for keys in simhash.probe_keys(prints, plan):
            order = np.argsort(keys, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                met |= {(int(a), int(b)) for a in group for b in group if a < b}
        for i in range(len(prints)):
            for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
                assert (i, i + 1 + int(j)) in met


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    want = brute.union_find({v for e in edges for v in e}, edges)
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    moved = {r.vertex: r.root for r in got.collect()}
    assert all(moved.get(v, v) == root for v, root in want.items())


def plain_best_fit(sizes, conflicts, capacity):
    bins, out = [], []
    for size, keys in zip(sizes, conflicts):
        fits = [b for b in range(len(bins)) if bins[b][0] >= size and not bins[b][1] & set(keys)]
        if not fits:
            bins.append([capacity, set()])
            fits = [len(bins) - 1]
        best = min(bins[b][0] for b in fits)
        out.append(best)
        chosen = next(b for b in fits if bins[b][0] == best)
        bins[chosen][0] -= size
        bins[chosen][1] |= set(keys)
    return out


def test_best_fit_takes_the_tightest_bin():
    draw = random.Random(2)
    for _ in range(40):
        sizes = sorted((draw.randrange(1, 90) for _ in range(120)), reverse=True)
        keys = [(draw.randrange(12), 100 + draw.randrange(60)) for _ in sizes]
        placed = packing.pack_group(sizes, keys, 100)
        room, held = {}, {}
        for (b, start), size, own in zip(placed, sizes, keys):
            others = [x for x in room if x != b and room[x] >= size and room[x] < room.get(b, 100)]
            assert all(held[x] & set(own) for x in others)
            assert start == 100 - room.get(b, 100) and size <= room.get(b, 100)
            assert not held.get(b, set()) & set(own)
            if b not in room:
                assert all(held[x] & set(own) for x in room if room[x] >= size)
            room[b] = room.get(b, 100) - size
            held.setdefault(b, set()).update(own)


def test_packing(spark, small):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = packing.pack(docs, capacity=300, with_text=True).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    texts, bins = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.piece_text
        assert len(brute.words(r.piece_text)) == r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert texts == {d: t or "" for d, t in small}
    whole = dict(small)
    for own in bins.values():
        end = 0
        for r in sorted(own, key=lambda r: (r.bin_start, r.n_words)):
            assert r.bin_start == end
            end += r.n_words
        assert end <= 300
        assert len({source[r.doc_id] for r in own}) == len({whole[r.doc_id] for r in own}) == len(own)


def test_binomial_limit(spark):
    from fractions import Fraction
    from math import comb

    cases = [(n, p, e) for n in (0, 1, 5, 60, 400, 1500) for p in (0.01, 0.1) for e in (0.05, 0.001)]
    for n, p, e in cases:
        total, want, exact = Fraction(0), -1, Fraction(str(p))
        for k in range(n + 1):
            total += comb(n, k) * exact**k * (1 - exact) ** (n - k)
            if total > e:
                break
            want = k
        limit = quality.binomial_limit(F.lit(n), p, F.lit(e))
        assert spark.range(1).select(limit.alias("k")).first().k == want, (n, p, e)


def test_cutoffs_bound_false_rejection(spark):
    draw = random.Random(4)
    stats = lambda: {
        **{rule: draw.random() for rule in quality.GRIDS}, "base_failed": False,
    }
    kinds = ", ".join(f"{rule}: double" for rule in quality.GRIDS)
    rows = [(f"s{i % 2}", stats()) for i in range(3000)] + [("few", stats())]
    frame = spark.createDataFrame(rows, f"stratum string, stats struct<{kinds}, base_failed: boolean>")
    chosen = {r.stratum: r.cut for r in quality.cutoffs(frame).collect()}
    assert all(c == float("inf") for c in chosen["few"])
    for s in ("s0", "s1"):
        own = [v for k, v in rows if k == s]
        for rule in quality.GRIDS:
            over = sum(v[rule] > chosen[s][rule] for v in own)
            assert over / len(own) <= quality.RISK / len(quality.GRIDS)


def test_disclosing_terms(spark, docs_of):
    filler = [f"filler{i} common words stand here" for i in range(60)]
    told = [f"ask zanzibar at boss@corp.org about item{i} common" for i in range(4)]
    partly = [f"common nothing known{i} zanzibarish" for i in range(4)]
    texts = filler + told + partly
    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    named = {d: [m.found for m in r.terms] for d, r in got.items() if r.terms}
    assert set(named) == {60, 61, 62, 63}
    assert all("zanzibar" in v and "common" not in v for v in named.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == texts[0]
    assert "zanzibar" not in clean[60] and "[EMAIL]" in clean[60] and "boss" not in clean[60]
