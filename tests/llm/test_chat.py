import hashlib
import random

from pyspark.sql import functions as F

from metrolith.llm import chat

PARTS = ["\\", "###", "#", "</turn>", "<turn/>", "<turn", "/>", "\n", "### user:\n", "\\s", "\\h", "\\e", "\\m", "ok", "é🙂", " ", ":", "\\\\s", "<", "</turn"]


def conversations():
    r = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 12)):
            text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "system", "a:\nb", "###", None]), text if r.random() < 0.95 else None))
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (70, None, "assistant", None)]
    rows += [(80, t, "assistant" if t % 3 else "user", f"t{t}\\") for t in range(700)]  # longer than a block of the prefix sums
    r.shuffle(rows)
    return rows


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df.repartition(4))
    got = {r.conv_id: r for r in chat.with_loss(out.withColumn("turns", chat.read_back("formatted")), "formatted", "loss_spans", "loss").collect()}
    digests = {r.conv_id: r for r in chat.digest(out).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        want = [(role, text) for _, _, role, text in sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        g = got[c]
        assert [(x.role, x.text) for x in g.turns] == want
        loss = "".join(t for r, t in want if r == "assistant")
        assert g.loss == loss and len(g.loss_spans) == sum(r == "assistant" for r, _ in want)
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        assert g.formatted.count("</turn>\n") == blocks and g.formatted.count("<turn/>") == len(want) - blocks
        d = digests[c]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(want), len(loss), len(g.formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert "Python" not in chat.digest(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert chat.digest(chat.format_conversations(df.where(F.lit(False)))).collect() == []
