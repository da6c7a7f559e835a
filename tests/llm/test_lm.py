import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metrolith.llm import lm


def test_scores_match_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["É"]
    rows = [(i, " ".join(r.choice(words[: 8 if i % 3 == 0 else 41]) for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, " \n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(4)
    good = spark.createDataFrame([(i,) for i, _ in rows if i is not None and i % 3 == 0 and i < 150] + [(None,), (3,)], "doc_id long")
    got = {x.doc_id: x for x in lm.cross_entropy_difference(docs, good).collect()}
    tokens = {i: [b"".join([w]).lower() for w in (t or "").encode().split()] for i, t in rows}

    def counts(ids):
        uni, bef, pair = Counter(), Counter(), Counter()
        for i in ids:
            for a, b in zip([None, *tokens[i]], tokens[i]):
                uni[b] += 1
                bef[a] += 1
                pair[a, b] += 1
        return uni, bef, pair

    target, every = counts([i for i in tokens if i % 3 == 0 and i < 150]), counts(tokens)
    share = sum(target[0].values()) / sum(every[0].values())

    def loss(model, scale, i, within):
        total, t = 0.0, tokens[i]
        own = counts([i] if within else [])
        mass = (sum(model[0].values()) - sum(own[0].values())) * scale
        for a, b in zip([None, *t], t):
            p = ((model[0][b] - own[0][b]) * scale + 1) / (mass + 2**lm.WORD_BITS)
            total -= math.log2(((model[2][a, b] - own[2][a, b]) * scale + 2 * p) / ((model[1][a] - own[1][a]) * scale + 2))
        return total / max(1, len(t))

    assert len(got) == len(rows)
    for i, t in tokens.items():
        assert got[i].n_tokens == len(t)
        assert got[i].target_loss == pytest.approx(loss(target, 1, i, i % 3 == 0 and i < 150), abs=2e-3)
        assert got[i].background_loss == pytest.approx(loss(every, share, i, True), abs=2e-3)
        assert got[i].score == pytest.approx(got[i].target_loss - got[i].background_loss, abs=1e-9)
    like = [got[i].score for i in tokens if i % 3 == 0 and i < 150 and tokens[i]]
    rest = [got[i].score for i in tokens if i % 3 and i < 150 and tokens[i]]
    assert max(like) < sum(rest) / len(rest)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.cross_entropy_difference(docs, docs.select("doc_id")).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert lm.cross_entropy_difference(docs, docs.select(F.lit(None).cast("long"))).count() == 2


def test_counts_stay_exact_past_any_table(spark, monkeypatch):
    """More distinct pairs than any table of fixed size holds; every text comes twice, so that each leaves a count in the models."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 300_000)
    n, width = 4400, 1000
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(0, {width - 1}), j -> concat('w', (id div 2) * {width} + j)), ' ')").alias("text"))
    got = lm.cross_entropy_difference(docs, docs.where("doc_id % 2 = 0").select("doc_id")).collect()
    vocabulary, strength = n // 2 * width + 1, 2.0
    assert len(got) == n and n // 2 * width > 2**21

    def loss(once, starts, mass):
        p = strength * (once + 1) / (mass + vocabulary)
        return -(math.log2((once + p) / (starts + strength)) + (width - 1) * math.log2((once + p) / (once + strength))) / width

    even, odd = loss(0.0, n / 2 - 1, (n / 2 - 1) * width), loss(1.0, n / 2, n / 2 * width)
    background = loss(0.5, (n - 1) / 2, (n - 1) * width / 2)
    for x in got:
        assert x.background_loss == pytest.approx(background, abs=1e-9)
        assert x.target_loss == pytest.approx(odd if x.doc_id % 2 else even, abs=1e-9)


def test_text_column_of_another_name_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", True), (2, "a b d", "y", False), (None, None, "z", None)], "doc_id long, body string, text string, target boolean")
    got = {x.doc_id: x.n_tokens for x in lm.cross_entropy_difference(docs, docs.select("doc_id"), text="body").collect()}
    assert got == {1: 3, 2: 3, None: 0}
