"""The pipeline's stages on the smallest tables, each held against plain Python on its own input."""

import itertools

import corpus_pipeline
import pytest
from compare import differences, duck
from test_operators import brute_contamination, closure, split

from tallystone.llm import mixing, queries
from tallystone.llm._shared import Scratch, source

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE_SQL[name]) == ""


def test_stages(spark):
    scratch, docs = Scratch(spark, "test"), source(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, SF), name)
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]

    before, after = seen["quality_classifier"]
    rated = {r.doc_id: (r.quality, r.toxic) for r in source(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in after}
    good = [i for i, x in rated.items() if x == (1, 0)]
    bad = [i for i, x in rated.items() if x != (1, 0)]
    assert kept <= {r.doc_id for r in before} and sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)

    before, after = seen["line_dedup"]
    assert [r.doc_id for r in sorted(before)] == [r.doc_id for r in sorted(after)] and all(r.n_chars == len(r.text) for r in after)

    before, after = seen["ngram_jaccard_join"]
    sets = {}
    for r in before:
        w = split(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = closure(sets, links)
    assert sorted(r.doc_id for r in after) == sorted(i for i in sets if roots[i] == i)

    before, after = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in source(spark, SF, "benchmark").collect()]
    clean = [x[0] for x in brute_contamination([(r.doc_id, r.text, None) for r in before], items) if not x[5]]
    assert sorted(r.doc_id for r in after) == sorted(clean)

    before, after = seen["source_mixing"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    names = sorted({r.source for r in before})
    sizes = [sum(len(split(r.text)) for r in before if r.source == s) for s in names]
    for s, t in zip(names, mixing.targets(sizes, mixing.cycle_weights(names)), strict=True):
        assert abs(sum(r.taken for r in after if r.source == s) - t) <= 3 * mixing.BLOCK
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, after))


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows, no ratings, no items, and columns with names that operators use within."""
    text = "here are some plain words of a text that is " + "as long as it must be " * 4
    docs = [(1, text, "en", "s", 5, "x"), (1, text, "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "", "en", None, 0, "x"), (3, text.upper(), "en", "t", 1, "y"), (None, "alone here", "en", "t", 1, "y")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 34), ("2", 0), ("None", 0), ("None", 2)]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
