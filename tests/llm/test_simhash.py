import random

import numpy as np
import pytest
import xxhash

from metrolith.llm import simhash


def brute_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def sample_texts() -> list[str]:
    r = random.Random(5)
    vocabulary = ["a", "of", "Straße", "ÉTÉ", "x" * 45, "the", " nb", "loooooooooooooong", "B", "c1"]
    texts = ["", "  ", "one", "one Two", "\t\n", "a b c", " a  b\x0bc\x0cd ", "ends with space "]
    return texts + [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) for _ in range(200)]


def test_fingerprints_match_brute_force():
    texts = sample_texts()
    assert simhash.simhashes([t.encode() for t in texts]).tolist() == [brute_fingerprint(t) for t in texts]


def test_close_pairs_match_brute_force():
    r = np.random.default_rng(3)
    centres = r.integers(0, 2**63, 9, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for c in centres] + [centres, r.integers(0, 2**63, 200, dtype=np.uint64)]))
    group = np.sort(r.integers(0, 4, len(values)))
    found = {p for i, j in simhash.close_pairs(values, group, 2) for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if group[a] == group[b] and int(values[a] ^ values[b]).bit_count() <= 2}
    assert found == want and want


def brute_components(rows):
    fps = {i: brute_fingerprint(t or "") for i, t in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (f"{fps[i]:016x}", top(i)) for i in ids}


def test_groups_match_brute_force(spark, monkeypatch):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base * 12:
        c = list(b)
        for _ in range(r.randint(0, 2)):
            c[r.randrange(len(c))] = r.choice(words)
        texts.append(" ".join(c))
    rows = list(enumerate([*texts, None, "", "short", "Short"], start=3))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string").repartition(5)
    want = brute_components(rows)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < 0.8 * len(rows)  # the fixture does hold groups
    # Buckets split by further bits give the same links.
    low = docs.select("doc_id", "text")
    fps = simhash.fingerprints(low).groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "low")
    from metrolith.operators.graph import connected_components

    parts = [sorted((x.node, x.component) for x in connected_components(simhash.links(fps, 2, most)).collect()) for most in (3, 2048)]
    assert parts[0] == parts[1]


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert [(x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [(None, 4), (4, 4), (4, 4)]


def test_similar_groups(spark, monkeypatch):
    """Pairs well above the similarity are linked, pairs well below it aren't; splitting large buckets loses none of them."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(r.choice([200, 600, 1200]))] for _ in range(40)]
    texts, origin, edits = [], [], []
    for n, b in enumerate(base):
        for share in (0, 0.005, 0.01, 0.1, 0.2):
            c = list(b)
            for _ in range(int(share * len(c)) + (share > 0)):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(" ".join(c))
            origin.append(n)
            edits.append(share)
    shingles = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (None, texts[0], 1)], "doc_id long, text string, node int").repartition(3)
    for most in (2048, 2):
        got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs, most=most).collect()}
        assert got[900] == got[901] == 900 and got[None] == got[0]
        near = [(a, b) for a in range(len(texts)) for b in range(a) if origin[a] == origin[b] and like(a, b) >= 0.88]
        assert len(near) > 40 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
        assert all(origin[c] == origin[a] for a, c in got.items() if a is not None and a < 900)
        apart = [i for i in range(len(texts)) if edits[i] == 0.2 and max(like(i, j) for j in range(len(texts)) if j != i and origin[j] == origin[i]) < 0.6]
        assert len(apart) > 20 and all(got[i] == i for i in apart)
    assert simhash.similar_groups(docs.limit(0)).collect() == []


def test_buckets_over_2048_lose_no_pair(spark):
    """Thousands of texts share a long passage, so buckets pass 2048; what hangs together is what whole buckets give."""
    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(20000)}" for _ in range(n)]
    passage, texts, near = say(120), [], []
    for i in range(2600):
        texts.append(passage + say(90))
        if i % 13 == 0:
            c = list(texts[-1])
            for _ in range(4):
                c[125 + r.randrange(80)] = f"x{r.randrange(20000)}"
            near.append((len(texts) - 1, len(texts)))
            texts.append(c)
    order = simhash._sampled(4, 2, 42)
    fp = simhash.simhashes([" ".join(t).encode() for t in texts], 5, 42, 4)
    largest = max(np.unique(simhash._keys(fp, order[t], 2), return_counts=True)[1].max() for t in range(2))
    assert largest > 2048
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got, whole = ({x.doc_id: x.component_id for x in simhash.similar_groups(docs, tables=2, key_bits=2, **kw).collect()} for kw in ({}, {"most": 10**9}))
    assert got == whole
    assert sum(got[a] == got[b] for a, b in near) == sum(whole[a] == whole[b] for a, b in near) >= 0.7 * len(near)


@pytest.mark.parametrize("most", [8, 2048])
def test_recall_of_similar_groups(spark, most):
    """Pairs of a similarity of 0.8 or more, by brute force over five-word shingles, at two sizes beyond which buckets are split."""
    r = random.Random(31)
    rows, sets = [], []
    for i in range(260):
        words = [f"w{r.randrange(30_000)}" for _ in range(r.randint(60, 400))]
        rows.append(words)
        edited = list(words)
        for _ in range(max(1, round(len(words) * r.uniform(0.002, 0.022)))):
            edited[r.randrange(len(edited))] = f"e{r.randrange(9)}"
        rows.append(edited)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in rows]
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs, 0.8, most=most).collect()}
    alike = [2 * i for i, j in enumerate(near) if j >= 0.8]
    assert len(alike) > 100 and sum(got[i] == got[i + 1] for i in alike) >= 0.9 * len(alike)
    apart = [2 * i for i, j in enumerate(near) if j < 0.65]
    assert sum(got[i] == got[i + 1] for i in apart) <= 0.1 * max(1, len(apart))
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_very_long_texts_in_pieces(spark, monkeypatch):
    """Pieces of a few words give the fingerprint of the whole, with odd white space, long words and repeats."""
    from metrolith.llm import text

    r = random.Random(6)
    texts = ["".join(r.choice(["a", "bb", "\u00e9", "w" * 30, "c1"]) + r.choice([" ", "\n", "  \t"]) for _ in range(n)) for n in (0, 1, 2, 3, 40, 400)] + ["   ", " x ", "y" * 300]
    whole = [simhash.simhashes([t.encode()], 3, 42, w).tolist() for t in texts for w in (1, 6)]
    monkeypatch.setattr(text, "LONG", 16)
    monkeypatch.setattr(text.pieces, "__defaults__", (16,))
    assert whole == [simhash.simhashes([t.encode()], 3, 42, w).tolist() for t in texts for w in (1, 6)]
    for t in texts:
        words = t.encode().split()
        runs = [tuple(p.split()[i : i + 3]) for p in text.pieces(t.encode(), 3, 16) for i in range(len(p.split()) - 2)]
        assert runs == [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
