import hashlib
import random

from pyspark.sql import functions as F

from metrolith.llm import substring


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - width + 1):
                k = tuple(w[j : j + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - width + 1):
            if i is not None and first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for n, x in enumerate(w) if n not in gone)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    joined = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256)).collect()], key=str)


def rows():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß x"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line = say(30), say(9)
    out = []
    for i in range(90):
        w = say(r.randint(0, 60))
        if r.random() < 0.5:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 6) : r.randint(20, 30)]
        if r.random() < 0.2:
            w = w + line * r.randint(2, 9)
        if i and r.random() < 0.2:
            w = out[r.randrange(i)].split()
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += ["a " * 400, " a\ta\n" * 90, "", None, "\n"]
    pairs = list(enumerate(out))
    pairs += [(7, out[7]), (7, out[8]), (None, out[3]), (500, out[3] + "  tail")]
    r.shuffle(pairs)
    return pairs


def test_matches_brute_force(spark):
    pairs = rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in pairs], "doc_id long, text string, rk int").repartition(6)
    want = brute(pairs, 12)
    assert sum(w[2] for w in want) > 500
    assert got(substring.dedup_substrings(docs, 12, 3)) == want
    assert got(substring.dedup_substrings(docs, 12, 3, most=2)) == want  # all but the smallest buckets dealt out by window


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_substrings(docs).collect() == []


def test_long_texts_give_the_same_windows(monkeypatch):
    """In pieces of a few words, every window of a text stands at its place once, under the same minimiser."""
    from metrolith.llm import text

    r = random.Random(3)
    texts = ["".join(f"w{r.randrange(50)}" + r.choice([" ", "\n", " \t "]) for _ in range(n)).encode() for n in (5, 300, 0, 12, 200)]

    def windows():
        out = []
        for lo, some, begins in substring._joined(texts, 12):
            of, mini, first, n, _ = substring.super_kmers(some, 12, 3)
            out += [(lo + (0 if begins is not None else int(o)), int(f) + j + (int(begins[o]) if begins is not None else 0), int(m)) for o, m, f, c in zip(of, mini, first, n) for j in range(int(c))]
        return sorted(out)

    whole = windows()
    assert len(whole) == sum(max(0, len(t.split()) - 11) for t in texts)
    monkeypatch.setattr(substring, "LONG", 64)
    monkeypatch.setattr(text.pieces, "__defaults__", (64,))
    assert windows() == whole


def test_formatting_stays(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, passage), (2, f"  head\n\n{passage}\n\n  tail\tend\n"), (3, f"x\n {passage} \n"), (4, f"{passage}\ny")], "doc_id long, text string")
    kept = {x.doc_id: x.kept_text for x in substring.dedup_substrings(docs, 12, 3).collect()}
    assert kept == {1: passage, 2: "  head\n\ntail\tend\n", 3: "x\n ", 4: "y"}
