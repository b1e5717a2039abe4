"""Vector codes, filter audit and neighbours against plain re-computations, on odd tables too."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from levelwise.llm import audit, codes, graph, neighbours, queries

NAN, INF = float("nan"), float("inf")


# ---- vector codes


def test_orchard_is_the_nearest_entry_with_ties_to_the_first():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 64):
        book = rng.integers(-6, 7, (size, 3))
        book[size // 2] = book[0]  # equal entries
        points = rng.integers(-8, 9, (400, 3))
        apart = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        nearest, near = codes.orchard(points, book)
        assert (nearest == apart.argmin(axis=1)).all() and (near == apart.min(axis=1)).all()


def plain_codes(rows, parts, entries, rounds):
    good = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    cut = lambda v, p: v[len(v) // parts * p : len(v) // parts * (p + 1)]
    least = {}
    for i, _, v in good:
        least[i] = min(least.get(i, v), v)
    first = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[cut(least[i], p) for i in first] for p in range(parts)]

    def assign():
        out = []
        for _, _, v in good:
            own = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
                own.append((d.index(min(d)), min(d)))
            out.append(own)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, _, v), own in zip(good, found) if own[p][0] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [
        (i, "".join(f"{e:02x}" for e, _ in own), sum(d for _, d in own), label)
        for (i, label, _), own in zip(good, assign())
    ]
    sums = Counter()
    for *_, d, label in done:
        sums[label] += d
    return sorted(((i, c, d, sums[label], digest) for i, c, d, label in done), key=str)


def test_codes_of_an_odd_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 2)], int(i % 3)) for i in range(40)]
    rows += [rows[0], rows[7], (None, [0.5] * 8, None), (5, [0.25] * 8, None), (-9, None, 1)]
    rows += [(100, [NAN] * 8, 1), (101, [1.0, None] * 4, 1), (102, [INF] * 8, 1), (103, [-0.001] * 8, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = table.select("*", *[F.lit("x").alias(c) for c in ("_ints", "_vector", "code", "error", "part", "_label")])
    as_stored = [tuple(r) for r in table.collect()]
    for entries, rounds in ((64, 2), (6, 3)):
        got = codes.compressed(clash, "embedding", 4, entries, rounds).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_codes(as_stored, 4, entries, rounds)
    assert codes.compressed(table.limit(0)).count() == 0
    assert codes.compressed(table.where("vec_id = 100")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(table, parts=3)


# ---- filter audit


def plain_audit(docs, labels):
    flags = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            flags[i][0] |= quality == 1
            flags[i][1] |= toxic == 1
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        own = brute.words(t)
        failed = [
            len(own) < 100,
            100 * len(set(own)) < 80 * len(own),
            100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t),
            i is not None and i > least[t],
        ]
        failed = {f for f, x in zip("ABCDE", failed) if x}
        rows[lang or ""].append((failed, *(flags[i] if i is not None else (False, False))))
    out, shapley = {}, Counter()
    for part, members in rows.items():
        for order in permutations("ABCDE"):
            for s in range(5):
                gone = [bool(f & set(order[:s])) for f, _, _ in members]
                hit = [order[s] in f for f, _, _ in members]
                now = [h and not g for h, g in zip(hit, gone)]
                shapley[part, order[s]] += sum(now)
                out[part, "".join(order), s + 1] = [
                    len(members) - sum(gone) - sum(now), sum(now), sum(h and g for h, g in zip(hit, gone)),
                    sum(f == {order[s]} for f, _, _ in members),
                    sum(n and m[1] for n, m in zip(now, members)), sum(n and m[2] for n, m in zip(now, members)),
                ]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def odd_corpus():
    plain = " ".join(f"w{i}" for i in range(120))
    texts = [plain, plain + " #", "A" * 30, " ".join(["same word"] * 80), "", None, plain.upper(), " \n\t", "naïve ẞ 𝒳"]
    # Ids fall from file to file, so nearly every file takes back what an earlier one counted.
    docs = [(1000 - 7 * i, texts[i % len(texts)], ("en", "de", None)[i % 3]) for i in range(90)]
    docs += [(3, plain, "en"), (3, plain, "de"), (3, plain, "en"), (None, plain, "en"), (None, None, None), (4, plain, "fr")]
    labels = [(1000 - 7 * i, i % 2, i % 5 == 0) for i in range(0, 90, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(3, None, 1), (3, 1, None), (None, 1, 1), (4, 0, 0)]
    return docs, labels


def stored_docs(spark, docs, path, files):
    step = -(-len(docs) // files)
    for k in range(files):
        some = spark.createDataFrame(docs[k * step : (k + 1) * step], "doc_id long, text string, lang string")
        more = [F.lit(1).alias(c) for c in ("key", "mask", "n", "good", "least", "batch_no")]
        some.coalesce(1).select("*", *more).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("files", [1, 11])
def test_audit_of_an_odd_corpus(spark, tmp_path, files):
    docs, labels = odd_corpus()
    path = stored_docs(spark, docs, str(tmp_path / "docs"), files)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audited_filters(spark, path, table).select(*AUDITED).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(docs, labels)


def test_audit_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    docs, labels = odd_corpus()
    path = stored_docs(spark, docs, str(tmp_path / "docs"), 6)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    work, kept = str(tmp_path / "work"), audit._Auditor._kept

    def failing(self, name, df, batch):
        if batch == 3 and name == "counters":
            raise RuntimeError("lost")
        return kept(self, name, df, batch)

    monkeypatch.setattr(audit._Auditor, "_kept", failing)
    with pytest.raises(Exception, match="lost"):
        audit.failure_counts(spark, path, table, work)
    monkeypatch.setattr(audit._Auditor, "_kept", kept)
    counts = audit.failure_counts(spark, path, table, work)
    got = audit.interaction_report(counts).select(*AUDITED).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(docs, labels)


def test_audit_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited_filters(spark, str(tmp_path / "docs"), labels).count() == 0


# ---- neighbours


def plain_neighbours(rows, nearest, every):
    good = [
        (i, np.array(v, dtype=float) * (2.0**-660 if max(v) > 1e150 else 1.0))
        for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for n, (q, v) in enumerate(good):
        if q is None or q % every:
            continue
        near = [
            (-float(neighbours.cosines(v, w[None])[0]), i is None, i or 0, i)
            for m, (i, w) in enumerate(good)
            if m != n and len(w) == len(v)
        ]
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(near)[:nearest], 1)]
    return sorted(out, key=str)


def test_neighbours_of_an_odd_table(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, [1.0] + [0.0] * 5) for i in range(0, 40)]  # a common vector
    rows += [(50, rows[50][1]), (None, rows[3][1]), (200, None), (250, [0.0] * 6), (300, [NAN] * 6), (350, [None, 1.0] * 3)]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (450, []), (500, [1e200, 1e200] + [0.0] * 4), (550, [3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = table.select("*", *[F.lit(0).alias(c) for c in ("vector", "dim", "k1", "shard", "least", "list", "at")])
    # Shards of eight nodes each: many shards, and each beam holds all of one.
    got = neighbours.nearest_neighbours(clash, nearest=5, every=10, shard_rows=8).collect()
    want = plain_neighbours(rows, 5, 10)
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    scores = {(q, r): s for q, r, _, s in want}
    assert all(abs(r.score - scores[r.query_id, r.rank]) < 1e-12 for r in got)
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(table.where("vec_id = 300")).count() == 0


def test_recall_over_a_whole_table(spark):
    """At least 0.9 of the true nearest rows, with the graph searched far less than whole."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {(q, i) for q, _, i, _ in plain_neighbours([tuple(r) for r in rows], 5, 50)}
    found = queries.queries()["op13_nearest_neighbours"](spark, folder).collect()
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_pruned_edges_lead_apart():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 16)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1)[:, None]
    edges, entry = graph.build(points, degree=12, width=24)
    assert edges.shape == (600, 13) and all(len(set(e[e >= 0])) == (e >= 0).sum() for e in edges)
    assert not (edges == np.arange(600)[:, None]).any()
    # Every node can be reached, and no edge is covered by a nearer one of the same node, but for those added to reach.
    reached, todo = {entry}, [entry]
    while todo:
        new = set(edges[todo.pop()].tolist()) - reached - {-1}
        reached |= new
        todo += new
    assert len(reached) == 600
    for node, own in enumerate(edges):
        own = own[:12][own[:12] >= 0]
        near = ((points[own] - points[node]) ** 2).sum(axis=1)
        order = np.argsort(near)
        for a in range(len(order)):
            for b in order[a + 1 :]:
                between = ((points[own[order[a]]] - points[own[b]]) ** 2).sum()
                assert graph.RELAXED**2 * between > near[b] - 1e-4
