import hashlib
import random
import time

from metrolith.llm import chat


def test_a_long_conversation(spark):
    """Twenty thousand turns, some very long, with code points of one to four bytes, against plain Python."""
    r = random.Random(2)
    say = lambda n: "".join(r.choice(["a ", "é", "語", "😀", "\\", "###", "</turn>", "<turn/>", "\n"]) for _ in range(n))
    turns = [(1, i, r.choice(["user", "assistant", "assistant"]), say(40_000 if i % 5000 == 17 else r.randint(0, 30))) for i in range(20_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    began = time.perf_counter()
    got = chat.digest(chat.format_conversations(df)).collect()[0]
    took = time.perf_counter() - began
    every = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
    loss = "".join(text for _, _, role, text in turns if role == "assistant")
    assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
    assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert took < 40
