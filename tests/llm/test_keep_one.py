"""Each component keeps one document, whatever ids its documents have."""

from levelwise.llm import simhash


def test_one_document_of_each_component(docs_of):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in ("oak", "elm", "ash", "fir", "yew")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4])]
    kept = simhash.keep_one(docs_of(rows)).collect()
    want = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:]]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
