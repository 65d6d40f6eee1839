"""Labels that miss, and lexicons of many terms."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions.predicates import predicate
from parley.operators import intent, signals as S

HITS = "structured_hits struct<skills:array<string>,tools:array<string>,agent_names:array<string>,nodes:array<string>,purposes:array<string>,event_types:array<string>>"


def test_a_missed_single_label_is_false(spark):
    text = spark.createDataFrame([("hit", 0, "pay now"), ("miss", 0, "no")], "session_id string, part int, searchable_text string")
    plan = {"signals_required": [{"name": "pays", "method": "rule_based", "spec": {"keywords": ["pay"], "labels": ["yes"]}},
                                 {"name": "two", "method": "rule_based", "spec": {"keywords": ["pay"], "labels": ["yes", "false"]}}]}
    fv = S.with_signals(spark.createDataFrame([("hit",), ("miss",), ("none",)], "session_id string"), plan, text)

    def ids(tree):
        return {r.session_id for r in fv.where(predicate(tree, fv)).collect()}

    def cmp(value, name="pays", how="=="):
        return {"op": "CMP", "name": name, "cmp": how, "value": value}

    assert ids(cmp(False)) == ids(cmp(0)) == {"miss", "none"} and ids(cmp(False, how="!=")) == ids(cmp("yes")) == {"hit"}
    assert ids(cmp(True)) == ids(cmp("false")) == ids({"op": "IS_NULL", "name": "pays"}) == set()
    assert ids(cmp(True, how=">=")) == {"hit"} and ids({"op": "IN", "name": "pays", "values": [False, "no"]}) == {"miss", "none"}
    # of two labels the last is a text like any other
    assert ids(cmp(False, "two")) == set() and ids(cmp("false", "two")) == {"miss", "none"}


@pytest.mark.parametrize("indexed", [0, 10_000])
def test_many_terms_are_found_as_few_are(spark, monkeypatch, indexed):
    monkeypatch.setattr(intent, "INDEXED_TERMS", indexed)
    rng = random.Random(8)
    letters = "abé\n "
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    lexicon = {"a": {"keywords": terms[::2]}, "b": {"negative_keywords": [*terms[1::2], ""]}}
    said = {f"s{k}": ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))] for k in range(25)}
    parts = spark.createDataFrame([(s, i, t) for s, own in said.items() for i, t in enumerate(own)], "session_id string, part int, searchable_text string")
    hits = spark.createDataFrame([(s, ([], [], [], [], [], [])) for s in [*said, "silent"]], f"session_id string, {HITS}")
    names = {n: (kind, t) for n, _, kind, t, _ in intent.lexicon_terms(lexicon)}
    got = {r.session_id: {names[n] for n in r.terms} for r in intent.term_hits(parts, hits, lexicon).collect()}
    for s, own in said.items():
        whole = "\n".join(own).lower()
        assert got[s] == {(k, t) for k, t in names.values() if t in (whole[:800] if k == "opening" else whole)}
    assert got["silent"] == set()


def test_a_term_lies_under_its_rarest_gram():
    index = {t: g for g, _, t in intent.term_index([(0, "abcd"), (1, "abce"), (2, "xabc"), (3, "bcd")], 3)}
    assert [intent.gram_length(n) for n in (50, 500, 50_000, 10**9)] == [2, 3, 4, 6]
    assert index == {"abcd": "bcd", "abce": "bce", "xabc": "xab", "bcd": "bcd"}


def test_work_of_many_terms_follows_shared_grams(spark):
    """The plan compares a text with the terms its grams lead to, not with all of them."""
    texts = spark.range(3).select(F.col("id").alias("k"), F.lit("some words here").alias("v"))
    plan = intent._in_text(texts, "k", "v", [(i, f"term{i}") for i in range(5_000)])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "term4999" not in plan
