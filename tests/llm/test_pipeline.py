import random

import corpus_pipeline
from metrolith.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(21)
    words = [f"{a}{b}" for a in ("ka", "mo", "ri", "ten", "sul") for b in ("la", "ne", "vo", "ux", "ip", "em")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = say(70)
    rows = []
    for i in range(240):
        t = say(r.randint(3, 150))
        if i % 10 == 3:
            t += " idiot " + say(3) + " scum moron"
        if i % 17 == 5:
            t = say(20) + " " + passage + " " + say(30)
        rows.append([i, t, "en", f"src{i % 5}"])
    for i, of in ((300, 0), (301, 0), (302, 8), (303, 8)):
        rows.append([i, rows[of][1], "en", "copy"])
    rows += [[310, None, None, None], [311, "", "en", None], [312, "one", "en", "src0"], [None, say(40), "en", "src1"]]
    docs = [(*x, len(x[1] or "")) for x in rows]
    labels = [(i, 1, int(bool(t) and "idiot" in t)) for i, t, *_ in rows if i is not None and i % 2 == 1]
    return docs, labels, passage


def test_stages(spark, tmp_path):
    docs, labels, passage = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path / "sf")
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, sf).write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        seen[name] = d.collect()
        if name != "best_fit_packing":
            assert d.columns == COLUMNS
    text = {i: t for i, t, *_ in docs}
    toxic = {i for i, t in text.items() if t and "idiot" in t}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert kept == set(text) - toxic
    kept = {r.doc_id for r in seen["simhash_near_dedup"]}
    assert not kept & {300, 301, 302, 303, 311} and 310 in kept and {0, 8} <= kept
    assert len(seen["simhash_near_dedup"]) == len(kept)
    repeated = [r for r in seen["substring_dedup"] if passage in r.text]
    assert len(repeated) == 1 and repeated[0].doc_id == min(i for i, t in text.items() if i is not None and i in kept and passage in (t or ""))
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"])
    whole = {r.doc_id: r.text for r in seen["substring_dedup"]}
    counts = {}
    for r in seen["source_mixing"]:
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) == 2
    assert {p.doc_id for p in seen["best_fit_packing"]} == set(counts)
    total = corpus_pipeline.run(spark, sf).collect()
    assert sorted((str(p.doc_id), p.piece, p.ids_crc32) for p in total) == sorted((str(p.doc_id), p.piece, p.ids_crc32) for p in seen["best_fit_packing"])


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []
    for name in ("op1_best_fit_packing", "op2_simhash_near_dedup", "op3_toxicity", "op4_source_mixing", "op5_substring_dedup", "op7_minhash_fingerprints", "op9_lm_scoring"):
        assert QUERIES[name](spark, sf).collect() == []


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, extra columns with names that the operators use, and formatting, from end to end."""
    r = random.Random(8)
    say = lambda n: "".join(f"w{r.randrange(4000)}" + r.choice([" ", "\n  ", "\n\n"]) for _ in range(n))
    passage, head, tail = say(60), say(60), say(60)
    texts = {i: say(r.randint(5, 90)) for i in range(60)} | {60: head + "one\n " + passage + "two\n three", 61: "four\n\n" + passage + "five\n\tsix " + tail}
    rows = [(None if i % 9 == 1 else i - i % 2 if i < 60 else i, t, "en", f"s{i % 3}", len(t), i, {"component": i}) for i, t in texts.items()] + [(200, None, None, None, None, 200, None)]
    sf = str(tmp_path / "sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, words long, size map<string,long>"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, d, sf).write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        assert d.columns == [x.split()[0] for x in schema.split(", ")]
        seen[name] = {x.words: x for x in d.collect()}
    for name in ("toxicity", "simhash_near_dedup", "substring_dedup"):
        assert seen[name].keys() == {x[5] for x in rows}
    left = seen["substring_dedup"]
    assert left[61].text == "four\n\nfive\n\tsix " + tail and left[60].text == texts[60] and all(left[i].text == texts[i] for i in range(60))
    assert all(x.size == {"component": i} for i, x in left.items() if i != 200)
    assert all(left[i].text.startswith(x.text) for i, x in seen["source_mixing"].items())
    packed = corpus_pipeline.run(spark, sf)
    assert {str(x.doc_id) for x in packed.collect()} == {str(x.doc_id) for x in seen["source_mixing"].values()}


def test_null_and_repeated_ids_keep_distinct_documents(spark):
    r = random.Random(4)
    say = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(80))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d), (None, d), (9, e), (None, e), (3, e), (None, f), (None, None), (None, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == COLUMNS
    assert sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted([("None", a), ("None", b), ("7", c), ("7", d), ("3", e), ("None", f), ("7", "")])
