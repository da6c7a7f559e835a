import random
import re

import pytest

from metrolith.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(n=900):
    r = random.Random(1)
    sources = ["a", "b", None, "é", "Z", "", "tiny"]
    out = []
    for i in range(n):
        s = r.choices(sources, [300, 80, 60, 60, 200, 40, 2])[0]
        out.append((i if i % 50 else None, " ".join("w" for _ in range(r.randint(0, 40))) if i % 30 else None, s, i))
    return out + out[:20]


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("buckets", [500, 7])
def test_plan_matches_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size long")
    got = mixing.mix_plan(docs.repartition(5)).collect()
    again = mixing.mix_plan(docs.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.taken, str(r.positions))
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    by_size = {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes) and len(got) == len(data)
    taken = {}
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 2 * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(i, "w w w w", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    mix = mixing.range_sorted(mixing.mix_plan(docs)).collect()
    assert [r.position for r in mix] == sorted(r.position for r in mix)
    # The second source of three (weight 1) fades: its first half of the time holds 5/8 of it.
    plan = mixing.mix_plan(docs).collect()
    for share, idx in ((0.5, 0), (0.625, 1), (0.3125, 2)):
        name = "abc"[idx]
        p = [x for r in plan if "abc"[r.doc_id % 3] == name for x in r.positions]
        assert sum(x < 0.5 for x in p) / len(p) == pytest.approx(share, abs=0.02)


def test_mixed_documents(spark):
    data = [(i, "w " * (i % 9), "ab"[i % 2], f"x{i}") for i in range(200)] + [(None, "one two", "a", "n")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: r.taken for i, r in plan.items() if r.taken}


def test_mixed_documents_stand_in_training_order(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string").repartition(3)
    mix = mixing.range_sorted(mixing.mix_plan(docs)).collect()
    want = [r.doc_id for r in mix]
    assert len(want) > 600 and [r.doc_id for r in mixing.mixed_documents(docs).collect()] == want
    fading = mixing.mixed_documents(docs, schedules=(((0.0, 1.0), (1.0, 0.0)),) * 2 + (((0.0, 0.0), (1.0, 1.0)),))
    assert [r.doc_id for r in fading.collect()] != want


def test_mixed_documents_keep_their_rows_apart(spark):
    """Equal ids and sizes in two sources, repeated rows, null ids, extra columns and odd white space."""
    r = random.Random(3)
    say = lambda i: "".join(f"w{i}x{j}" + r.choice([" ", "\n", "\t  "]) for j in range(r.randint(1, 9)))
    data = [(i // 2 if i % 7 else None, say(i), "ab"[i % 2], f"e{i}", {"k": i}) for i in range(120)]
    docs = spark.createDataFrame(data + data[:9], "doc_id long, text string, source string, size string, extra map<string,int>").repartition(3)
    got = mixing.mixed_documents(docs).collect()
    whole = {x[3]: x for x in data}
    assert all(whole[g.size][1].startswith(g.text) and (g.doc_id, g.source, g.extra) == (whole[g.size][0], whole[g.size][2], whole[g.size][4]) for g in got)
    plan = mixing.mix_plan(docs).collect()
    for s in "ab":
        target = {round(p.target) for p in plan if p.source_size == sum(len(x[1].split()) for x in data + data[:9] if x[2] == s)}
        assert target == {sum(len(g.text.split()) for g in got if g.source == s)}
    cut = [g for g in got if g.text != whole[g.size][1]]
    assert len(cut) <= 2 and all(len(g.text.split()) < len(whole[g.size][1].split()) for g in cut)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).collect() == [] and mixing.mixed_documents(docs).collect() == []
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix_plan(docs).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
