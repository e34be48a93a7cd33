"""Registered queries: SQL twins, full tables, and the pipeline stage by stage."""

import math
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from cachescope.llm.common import documents, table, written
from cachescope.llm.queries import ORACLE, QUERIES
from cachescope.plans.crosscheck import compare, duckdb_with_tables

from ..conftest import SF_SMALL
from . import test_ngram_join as near
from .test_mixing import targets


def test_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}
    assert numbers == set(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_SMALL), duckdb_with_tables(SF_SMALL), ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op10_decontaminate", "op12_whitening", "op13_packing"}))
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF_SMALL).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in documents(spark, SF_SMALL).select("doc_id").collect())


def test_jaccard_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).select("doc_id", "text").collect()]
    want = near.brute(rows)
    got = {r.doc_id: (r.text_class, r.n_links, r.class_id) for r in QUERIES["op2_ngram_jaccard"](spark, SF_SMALL).collect()}
    assert got == {i: want[t or ""] for i, t in rows}


def test_leaks_equal_a_search_for_whole_items(spark):
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in table(spark, SF_SMALL, "benchmark").collect()]
    docs = [(r.doc_id, plain(r.text)) for r in documents(spark, SF_SMALL).collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = QUERIES["op10_decontaminate"](spark, SF_SMALL).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert {(r.doc_id, r.item_id) for r in got if r.similarity == 1.0} == want


def test_pipeline_stages(spark):
    docs = documents(spark, SF_SMALL)
    columns, rows = docs.columns, None
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.collect()}
        rows = out.collect()
        if name == "toxicity":
            model = pipeline.toxic_segments.fit(docs, table(spark, SF_SMALL, "labels"))
            toxic = {r.doc_id for r in pipeline.toxic_segments.score(docs, model).collect() if r.predicted}
            assert {r.doc_id for r in rows} == set(before) - toxic and toxic
        elif name == "ngram_jaccard":
            want = near.brute(sorted(before.items()))
            assert {r.doc_id for r in rows} == {w[2] for w in want.values()}
        elif name == "decontamination":
            hits = {r.doc_id for r in pipeline.decontaminate.contaminated(docs, table(spark, SF_SMALL, "benchmark")).collect()}
            assert {r.doc_id for r in rows} == set(before) - hits and hits
        elif name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in docs.collect():
                sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
            for r in rows:
                taken[r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
            assert {s: math.floor(t + 1e-9) for s, t in targets(sizes).items() if t >= 1} == dict(taken)
        docs = out
    final = pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert len(final) == len(rows)
    slots = defaultdict(list)
    for r in final:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
