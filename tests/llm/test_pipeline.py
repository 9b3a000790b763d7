"""The pipeline against its stages done plainly, one after the other."""

from __future__ import annotations

import corpus_pipeline
from pagemill.llm import simhash_bktree, transducer_bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    tables = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        tables[name] = docs.collect()
        assert {r.doc_id for r in tables[name]} <= seen
        docs = spark.createDataFrame(tables[name], docs.schema)
    letters = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    assert len(tables["language_id"]) >= 0.98 * len(letters)

    # one document of each group of linked fingerprints
    marks = {r.doc_id: simhash_bktree.fingerprint(r.text) for r in tables["language_id"]}
    group = {i: i for i in marks}
    for a in sorted(marks):
        for b in sorted(marks):
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 2 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert sorted(r.doc_id for r in tables["near_duplicates"]) == sorted(set(group.values()))
    assert sorted(r.doc_id for r in tables["secrets"]) == sorted(set(group.values()))
    assert not any("password=" in r.text for r in tables["secrets"])

    given = {r.doc_id: r.text for r in tables["secrets"]}
    words = lambda t: len(t.split())
    total = sum(map(words, given.values()))
    assert abs(sum(words(r.text) for r in tables["mixing"]) - 1.5 * total) <= len({r.source for r in tables["mixing"]})
    assert all(given[r.doc_id].startswith(r.text) or r.text == given[r.doc_id] or given[r.doc_id].lstrip().startswith(r.text.lstrip()) for r in tables["mixing"])


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    words = transducer_bpe.vocabulary(transducer_bpe.default_tokenizer())
    rows = found.collect()
    assert rows and all(words.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens for r in rows)
