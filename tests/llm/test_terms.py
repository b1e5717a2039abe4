"""Added spans of personal data, recomputed in plain Python over a whole table."""

import math
import re
from collections import defaultdict

import brute
from levelwise.llm import pii

SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}")


def secrets(text, base):
    for m in SECRET.finditer(text):
        good = re.search("[A-Za-z]", m[0]) and len(re.findall("[0-9]", m[0])) >= 4
        if good and not any(a < m.end() and m.start() < e for a, _, e, _ in base):
            yield m.start(), m.end()


def rungs(kind, value):
    digits = re.sub("[^0-9]", "", value)
    group = {
        "email": lambda: value.lower().rsplit("@", 1)[1], "ip": lambda: value.rsplit(".", 1)[0],
        "card": lambda: digits[:6], "phone": lambda: digits[:4],
    }.get(kind, lambda: None)()
    return [("value", kind, value), *([("group", kind, group)] if group is not None else []), ("kind", kind)]


def lower_end(k, n, z=1.645):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def told(texts):
    """Terms, and whether they are removed."""
    entities, near, held = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for w in brute.words(t):
            held[w].add(t)
        base = brute.personal(t)
        spots = [(a, e, kind) for a, _, e, kind in base] + [(a, e, "secret") for a, e in secrets(t, base)]
        for a, e, kind in spots:
            around = brute.words(t[:a])[-8:] + brute.words(t[e:])[:8]
            for rung in rungs(kind, t[a:e]):
                entities[rung].add(t)
                for w in around:
                    near[rung, w].add(t)
    out = {}
    for (rung, w), both in near.items():
        c = len(entities[rung])
        if c < 3 or w not in held or not any(x.isalnum() for x in w):
            continue
        likely, ic = lower_end(len(both), len(held[w])), math.log2(len(texts) / c)
        if ic > 0 and likely >= 0.5 and math.log2(likely) + ic >= 0.8 * ic:
            out[w] = out.get(w, False) or math.log2(likely) + ic >= 0.95 * ic
    return out


def compared(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    terms = told({t for _, t in rows})
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    changed = 0
    for doc, text in rows:
        base = brute.personal(text)
        own = list(secrets(text, base))
        taken = [(a, e) for a, _, e, _ in base] + own
        want = [
            (m.start(), m.end(), m[0], terms[m[0]])
            for m in re.finditer("[^\x20\x09-\x0d]+", text)
            if m[0] in terms and not any(a < m.end() and m.start() < e for a, e in taken)
        ]
        assert [(s.start, s.end) for s in got[doc].secrets] == own, doc
        assert [tuple(s) for s in got[doc].terms] == want, doc
        changed += bool(want)
    return terms, changed


def test_terms_of_a_whole_table(spark, data):
    terms, changed = compared(spark.read.parquet(f"{data}/documents.parquet"))
    assert terms and changed


def test_terms_of_each_rung(docs_of):
    filler = [f"plain line {i} with common words" for i in range(300)]
    far = "x" * 900  # longer than the stretch around an entity
    texts = filler + [f"common desk{i} zanzibar {far} u{i}@corp.org call" for i in range(8)]
    texts += [f"common rack 10.20.30.{i} here" for i in range(8)] + ["rack alone", "common call"]
    texts += [f"key = 'a1b2c3d4e5f6a7b8c9d{i}' common" for i in range(10, 17)] + [texts[-1]]
    terms, changed = compared(docs_of(list(enumerate(texts))))
    assert {"zanzibar", "rack", "call", "key"} <= set(terms) and "common" not in terms
    assert changed >= 20


def test_sanitised_secrets(docs_of):
    texts = [f"open sesame{i} key = a1b2c3d4e5f6a7b8c9d{i} now" for i in range(10, 16)] + [None, "", "key"]
    out = {r.doc_id: r.text for r in pii.sanitise(docs_of(list(enumerate(texts)))).collect()}
    assert all("[SECRET]" in out[i] and "a1b2" not in out[i] for i in range(6))
    assert out[6] == out[7] == ""
