"""Columns of the caller never meet an operator's own, whatever their names."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cachescope.llm import (common, components, decontaminate, licenses, line_dedup, mixing, ngram_join, packing, phrases, pii_bootstrap,
                            rendezvous, rule_ledger, token_files, toxic_segments, whitening)
from cachescope.llm.common import documents, table
from cachescope.llm.queries import END_ID, tokenizer_path

from ..conftest import SF_SMALL
from .helpers import frame, words


def names_in(*modules):
    """Every quoted name in the sources of some modules that could be a column's."""
    found = set()
    for m in modules:
        with open(m.__file__) as f:
            found |= set(re.findall(r"""["']([_a-z][_a-z0-9]*)["']""", f.read()))
    return sorted(found - {"doc_id", "text", "lang", "source", "path", "vec_id", "embedding"})


BASE = [(i, " ".join(words(i // 2, 80, 300)) + f"\nwrite to a{i}@ex.org now\nall rights are reserved by whom", f"s{i % 2}") for i in range(24)]


def _docs(spark):
    return frame(spark, BASE).withColumn("path", F.concat(F.lit("a/b/"), F.col("doc_id"))).drop("n_chars")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, " ".join(words(3, 80, 300)[10:40]))], "item_id long, text string")


OPERATORS = {
    "rendezvous": lambda s, d: rendezvous.assign(d, [1.0] * 4),
    "pii": lambda s, d: pii_bootstrap.find(d),
    "ledger": lambda s, d: rule_ledger.apply_policy(rule_ledger.ledger(d)),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "one_per_group": lambda s, d: ngram_join.one_per_group(d),
    "near_duplicates": lambda s, d: ngram_join.near_duplicates(d),
    "mix": lambda s, d: mixing.mix(d),
    "mixture": lambda s, d: mixing.mixture(d),
    "licenses": lambda s, d: licenses.scan(d),
    "toxic": lambda s, d: toxic_segments.score(d, toxic_segments.fit(d, _labels(s))),
    "without_toxic": lambda s, d: toxic_segments.without_toxic(d, _labels(s)),
    "contaminated": lambda s, d: decontaminate.contaminated(d, _benchmark(s)),
    "without_contaminated": lambda s, d: decontaminate.without_contaminated(d, _benchmark(s)),
    "tokens": lambda s, d: token_files.tokens_round_trip(d, tokenizer_path(), END_ID),
    "phrases": lambda s, d: phrases.collocations(d, min_count=2),
    "packing": lambda s, d: packing.pack(d, tokenizer_path(), 1),
}
MODULES = {"rendezvous": rendezvous, "pii": pii_bootstrap, "ledger": rule_ledger, "line_dedup": line_dedup,
           "one_per_group": ngram_join, "near_duplicates": ngram_join, "mix": mixing, "mixture": mixing,
           "licenses": licenses, "toxic": toxic_segments, "without_toxic": toxic_segments,
           "contaminated": decontaminate, "without_contaminated": decontaminate, "tokens": token_files,
           "phrases": phrases, "packing": packing}
#: Operators that return their input's rows, and so the caller's columns.
KEEP_COLUMNS = set(OPERATORS) - {"near_duplicates", "contaminated", "tokens", "phrases", "packing"}


def _plain(v):
    return bytes(v) if isinstance(v, bytearray) else repr(v)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_column_name(spark, name):
    docs = _docs(spark)
    plain = OPERATORS[name](spark, docs)
    mine = [n for n in names_in(MODULES[name], common, components) if n not in docs.columns]
    assert len(mine) > 20 and "_user0" not in mine
    mine += ["_user0", "_user1", "Mixed Case"]
    wide = docs.select("*", *[F.concat(F.lit(n + "/"), F.col("doc_id").cast("string")).alias(n) for n in mine])
    got = OPERATORS[name](spark, wide)
    rows = got.collect()
    # slots follow a hash of the whole row
    same = [c for c in plain.columns if (name, c) != ("rendezvous", "slot")]
    key = lambda r: repr([_plain(r[c]) for c in same])
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))
    if name in KEEP_COLUMNS:
        kept = [n for n in mine if n not in plain.columns]
        assert set(kept) <= set(got.columns) and rows
        assert all(r[n] == f"{n}/{r['doc_id']}" for r in rows for n in kept)


def test_whitening_any_column_name(spark):
    vec = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(50)
    wide = vec.select("vec_id", "embedding", *[F.lit("x").alias(n) for n in names_in(whitening, common)])
    want = {(r.vec_id, r.component, r.deviation) for r in whitening.whiten(vec).collect()}
    assert {(r.vec_id, r.component, r.deviation) for r in whitening.whiten(wide).collect()} == want


@pytest.mark.parametrize("at", range(len(pipeline.STAGES)))
def test_pipeline_stage_any_column_name(spark, at):
    stage = pipeline.STAGES[at][1]
    docs = documents(spark, SF_SMALL)
    plain = stage(spark, docs, SF_SMALL)
    names = names_in([toxic_segments, ngram_join, decontaminate, mixing, rendezvous][at], common, components)
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names if n not in docs.columns])
    got = stage(spark, wide, SF_SMALL)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect())
    assert set(names) <= set(got.columns)
