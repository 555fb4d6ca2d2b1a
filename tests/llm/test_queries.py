"""The registered queries against their SQL, and their schemas."""

import pytest

from millrace.llm import registry
from tests.oracle import assert_same

SCHEMAS = {
    "op1_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op2_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op4_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, data_dir, name):
    assert_same(spark, data_dir, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schema(spark, data_dir, name):
    found = dict(registry.queries()[name](spark, data_dir).dtypes)
    assert {k: found.get(k) for k in SCHEMAS[name]} == SCHEMAS[name]


def test_pipeline_agrees_with_its_stages(spark, data_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    from millrace.scratch import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, data_dir))
        assert docs.columns == before.columns
        assert docs.count() <= before.count()
        if name == "SimHash near-dedup":
            rows = before.select("doc_id", "text").collect()
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert kept == first_of_similar({r["doc_id"]: r["text"] for r in rows})
    last = corpus_pipeline.run(spark, data_dir)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert last.where("not round_trip").isEmpty()


def brute_component(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def first_of_similar(texts):
    """The smallest id of every group of texts that share 0.8 of their five-word shingles."""
    sets, group = {}, {i: i for i in texts}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    for a in sorted(sets):
        for b in sets:
            if a < b and group[a] != group[b]:
                shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if not union or shared >= 0.8 * union - 1e-9:
                    old, low = max(group[a], group[b]), min(group[a], group[b])
                    group = {i: low if g == old else g for i, g in group.items()}
    return {i for i, g in group.items() if g == i}
