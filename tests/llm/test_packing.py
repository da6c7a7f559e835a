import random
import zlib

import numpy as np
import pytest

from metrolith.llm import packing, tokens
from metrolith.llm.queries import tokenizer_path


def awkward_texts():
    r = random.Random(7)
    words = ["the", "Über", "don't", "I'll", "日本語", "naïve", "1234", "x=1;", "é", "a\u00a0b", "tab\there", "cr\r\nlf", "…", "foo.bar", "--", "'s", "\x1c", "\u2028", "<|endoftext|>", "🙂"]
    glue = [" ", " ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "   "]
    out = ["", " ", "\n", "  a", "a ", "a  ", "\na", " \n a \n "]
    for _ in range(400):
        out.append("".join(r.choice(words) + r.choice(glue) for _ in range(r.randint(1, 30))))
    return out + [" ".join(r.choice(words[:18]) for _ in range(200)) for _ in range(50)]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(tokenizer_path()), tokens.WordIds(tokenizer_path())
    for text in awkward_texts():
        assert np.frombuffer(w.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert w.fast is not None
    w.fast = None  # words are looked up where ids do not follow the merges
    for text in awkward_texts():
        assert np.frombuffer(w.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_in_parts():
    w = tokens.WordIds(tokenizer_path())
    for text in awkward_texts():
        if not any(s in text for s in (*w.special, *tokens.ODD)):
            for longest in (1, 7, 50):
                parts = list(tokens._in_parts(text, longest))
                assert "".join(parts) == text and b"".join(map(w._ids, parts)) == w._ids(text), repr(text)


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 8)
    w = tokens.WordIds(tokenizer_path())
    w.fast = None
    texts = [t for t in awkward_texts() if "<|" not in t][:150]
    one = [w.encode(t) for t in texts]
    assert len(w) <= 8 and one == [w.encode(t) for t in texts]


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(2)
    texts = ["", None, "one", "same", "same"] + [" ".join(r.choice(["alpha", "beta", "ga"]) for _ in range(r.randint(1, 260))) for _ in range(300)]
    rows = [(None if i == 4 else i, x, "z") for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack_documents(docs, tokenizer_path(), 64, keep_ids=True).cache()
    by_doc, by_seq = {}, {}
    for p in got.collect():
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _, _ in rows}
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        ps = sorted(by_doc[i], key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert [p.length for p in ps[1:]] == [64] * (len(ps) - 1) and sum(p.length for p in ps) == len(ids)
        for p in ps:
            part = np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert bytes(p.ids) == part and p.ids_crc32 == zlib.crc32(part)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    total = sum(p.length for ps in by_doc.values() for p in ps)
    assert len(by_seq) <= 1.05 * -(-total // 64) + 3
    seqs = {s.sequence_id: s for s in packing.sequences(got).collect()}
    for k, ps in by_seq.items():
        assert bytes(seqs[k].ids) == b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.offset))
    got.unpersist()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    r = np.random.default_rng(0)
    lengths = np.concatenate([r.integers(1, 2048, 800), r.integers(1, 30, 1500)])
    bins, offsets = packing.best_fit(lengths, 2048, 12, 2.5e6, rule=rule)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 2048 and len(mine) <= 12
        assert (mine.astype(float) ** 2).sum() <= 2.5e6 or len(mine) == 1
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == [0, *np.cumsum(mine[order])[:-1].tolist()]
    bins, _ = packing.best_fit(lengths, 2048, 2048, 2048.0**2)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 2048 + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []
