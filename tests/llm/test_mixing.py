import os

import pytest

from quillspark.llm import mixing
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")
DOCS = "doc_id bigint, text string, source string, tokens int, pattern string"
TARGETS = "source string, target_share double, max_repeat int"


def test_flow_repeats_only_where_it_must():
    plan = mixing.plan_mix({("a",): 1000, ("b",): 100, ("a", "b"): 50}, {"a": (0.5, 1), "b": (0.5, 3)})
    used = {p: sum(n for _, n in f) for p, f in plan.flows.items()}
    by = {}
    for flows in plan.flows.values():
        for s, n in flows:
            by[s] = by.get(s, 0) + n
    assert used["b",] == 300 and used["a", "b"] == 50  # the cap of its stricter source holds
    assert by["a"] == by["b"] == 350
    assert mixing.plan_mix({}, {"a": (1.0, 1)}).total == 0
    partial = mixing.plan_mix({("a",): 10}, {"a": (0.5, 1), "none": (0.5, 1)}, total=100)
    assert sum(n for f in partial.flows.values() for _, n in f) == 10


def test_shares_caps_and_seeds(spark):
    docs = [(i, f"word{i} " * (5 + i % 7), "big", 0, "") for i in range(300)] + [(1000 + i, f"tiny{i} " * 9, "small", 0, "") for i in range(20)] + [(2000, "shared text " * 9, "big", 0, ""), (2001, "shared text " * 9, "small", 0, ""), (3000, None, "big", 0, ""), (3001, "", "small", 0, ""), (3002, "x", None, 0, ""), (3003, "y", "other", 0, "")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("empty", 0.1, 2), ("small", 0.3, 3), (None, 0.5, 1)], TARGETS)
    df = spark.createDataFrame(docs, DOCS)
    mix = mixing.mix_sources(df, targets)
    got = mix.collect()
    total = sum(r["copies"] * r["tokens"] for r in got)
    share = sum(r["copies"] * r["tokens"] for r in got if r["source"] == "big") / total
    assert abs(share - 0.6 / 0.9) < 0.02
    assert all(r["copies"] <= (1 if r["source"] == "big" else 3) for r in got)
    assert not {r["doc_id"] for r in got} & {2001, 3000, 3001, 3002, 3003}  # copies stand under their least id
    assert sum(r["copies"] for r in got if r["doc_id"] == 2000) <= 1
    assert rows(mix) == rows(mixing.mix_sources(df, targets))  # the same seed gives the same mix
    report = {r["source"]: r for r in mixing.mix_shares(mix, targets).collect()}
    assert report["empty"]["actual_share"] == 0.0 and abs(report["big"]["actual_share"] - share) < 1e-12
    assert rows(mixing.mix_sources(df.limit(0), targets)) == []
    assert rows(mixing.mix_sources(df, targets.limit(0))) == []


def test_tokens_of_long_and_empty_texts(spark):
    df = spark.createDataFrame([("a b " * 50_000,), ("",), (None,)], "text string")
    assert sorted(r["tokens"] for r in mixing.count_tokens(df).collect())[:2] == [0, 0]
