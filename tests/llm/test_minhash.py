import hashlib
import random

import pytest

from metrolith.llm import minhash


def rows():
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "B"]
    out = [(i * 3, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for i in range(120)]
    out += [(1000, None), (1001, ""), (1002, "one"), (1003, out[5][1]), (1004, out[5][1])]
    return out


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_matches_brute_force(spark, buckets):
    pairs = rows()
    shuffled = pairs[:]
    random.Random(1).shuffle(shuffled)
    docs = spark.createDataFrame([(i, t, "x") for i, t in shuffled], "doc_id long, text string, bucket string").repartition(5)
    got = {x.doc_id: x for x in minhash.fingerprint_documents(docs, buckets=buckets).collect()}
    texts = [t or "" for _, t in pairs]
    assert len(got) == len(pairs)
    for n, (i, _) in enumerate(pairs):
        t, f = texts[n], texts[(n + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + f[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        sig = minhash.signatures([t.encode(), e.encode(), f.encode()])
        assert got[i].fingerprint == sig[0].astype(">u2").tobytes().hex()
        assert got[i].edited_fingerprint == sig[1].astype(">u2").tobytes().hex()
        assert got[i].near_edited == pytest.approx((sig[0] == sig[1]).mean()) and got[i].near_next == pytest.approx((sig[0] == sig[2]).mean())
    assert got[1003].near_next == 1.0 and got[1000].near_next == 1.0 and got[1001].near_next == 0.0


def test_estimates_jaccard():
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    worst = 0.0
    for share in (0.1, 0.5, 0.9):
        a = [r.choice(words) for _ in range(2000)]
        b = a[: int(2000 * share)] + [r.choice(words) for _ in range(2000 - int(2000 * share))]
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        s = minhash.signatures([" ".join(a).encode(), " ".join(b).encode()])
        worst = max(worst, abs(true - (s[0] == s[1]).mean()))
    assert worst < 0.13


def test_null_ids_repeated_rows_and_empty(spark):
    schema = "doc_id long, text string"
    assert minhash.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "q r s t"), (5, "q r s t"), (9, "last words")], schema)
    got = sorted(((x.doc_id, x.n_chars, x.near_next) for x in minhash.fingerprint_documents(docs, buckets=3).collect()), key=str)
    assert [g[0] for g in got] == [5, 5, 9, None] and sorted(g[2] for g in got if g[0] == 5) == [0.0, 1.0]


def test_classes_match_brute_force(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(15)]
    texts = []
    for b in base * 5:
        c = list(b)
        for _ in range(r.choice([0, 1, 1, 9])):
            c[r.randrange(len(c))] = "edited"
        texts.append(" ".join(c))
    texts += ["", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string").repartition(4)
    sets = {}
    for i, t in enumerate(texts, 10):
        w = (t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in sets:
        for b in sets:
            if a < b and top(a) != top(b) and (sets[a] == sets[b] or (sets[a] | sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                root[max(top(a), top(b))] = min(top(a), top(b))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    assert got == {i: top(i) for i in sets}
