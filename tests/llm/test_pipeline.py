import corpus_pipeline
from soundfield.llm import pii, toxicity
from soundfield.llm.shared import stored, table
from test_decontam import brute as brute_hits
from test_packing import check
from test_simhash import brute_components, brute_print


def test_every_stage_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    seen = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            scores = toxicity.train(docs, table(spark, small, "labels")).scores([r.text for r in seen.values()])
            want = {k for k, s in zip(seen, scores, strict=True) if s < 0.5}
        elif name == "near_duplicates":
            found = brute_components({k: brute_print(r.text) for k, r in seen.items()})
            want = {k for k, first in found.items() if k == first}
        elif name == "decontamination":
            want = {doc for doc, n, hit, _ in brute_hits([(k, r.text) for k, r in seen.items()], items, 13) if not (hit and 20 * hit >= n)}
        else:
            want = set(seen)
        before, model = seen, pii.train(docs) if name == "personal_data" else None
        out = stored(stage(spark, docs, small), name)
        if name == "packing":
            check(out.collect(), {k: r.text for k, r in seen.items()})
            break
        assert out.columns == columns
        rows = out.collect()
        seen = {r.doc_id: r for r in rows}
        assert len(seen) == len(rows) and set(seen) == want, name
        for k, r in seen.items():
            text = pii.redact(before[k].text, model) if model else before[k].text
            assert r.text == text and r.lang == before[k].lang and r.n_chars == (len(text) if model else before[k].n_chars)
        docs = out
