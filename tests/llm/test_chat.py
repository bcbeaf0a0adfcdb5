import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritstone.llm import chat

HARD = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|x", "<|", "|>", "a\nb", "", None, "<|im_end|>\n<|im_start|>user\nx", "\\n \\s", "é日🙂"]


def test_round_trip_of_control_strings(spark):
    rows = [(k % 4, k, ["user", "assistant", "sys\ntem\\", None][k % 4 if k % 5 else 1], t) for k, t in enumerate(HARD * 3)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(df).cache()
    back = sorted((r.conv_id is None, r.conv_id or 0, r.place, r.role, r.text, r.loss) for r in chat.parse(formatted).collect())
    want = []
    for conv in {r[0] for r in rows}:
        for place, (_, _, role, text) in enumerate(sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])):
            want.append((conv is None, conv or 0, place, role or "", text or "", (text or "") if role == "assistant" else None))
    key = lambda r: r[:3]
    assert sorted(back, key=key) == sorted(want, key=key)
    for r in formatted.collect():
        spans = "".join(r.formatted[m.start - 1 : m.start - 1 + m.length] for m in r.mask)
        assert "<|" not in spans


def test_digests(spark):
    df = spark.createDataFrame([(1, 0, "user", chat.HARD), (1, 1, "assistant", chat.HARD), (2, 0, "user", "hm")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(df)).collect()}
    assert got[1].loss_chars == len(chat.HARD) and got[1].loss_sha256 == hashlib.sha256(chat.HARD.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{chat.HARD}\nassistant\n{chat.HARD}\n".encode()).hexdigest() and got[2].loss_chars == 0


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 0, "open", "user", "hel"), (1, 0, 1, "delta", None, "lo"),
        (1, 1, 2, "open", "assistant", "bad"), (1, 1, 3, "delta", None, " answer"), (1, 1, 4, "regenerate", None, "good"), (1, 1, 5, "delta", None, " one"), (1, 1, 6, "delta", None, None),
        (2, 0, 0, "open", "user", "x"), (2, 0, 9, "edit", None, "y"),
        (3, 0, 0, "delta", "user", "only"), (3, 0, 1, "delta", None, " deltas"),
        # equal seq: delta, edit, open and regenerate follow each other by name
        (4, 0, 0, "open", "user", "A"), (4, 0, 1, "edit", None, "B"), (4, 0, 1, "regenerate", None, "C"), (4, 0, 1, "delta", None, "lost"), (4, 0, 2, "delta", None, "!"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, event string, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.reconstruct(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good one"), (2, 0): ("user", "y"), (3, 0): ("user", "only deltas"), (4, 0): ("user", "C!")}
    assert chat.digests(chat.render(chat.reconstruct(df.limit(0)))).count() == 0


def test_replayed_logs_give_the_messages_back(spark):
    rows = [(k % 3 or None, k, ["user", "assistant", None][k % 3], t) for k, t in enumerate(HARD * 3)]
    log = chat.replay(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.event for r in log.select("event").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    got = sorted(((r.conv_id or 0, r.turn, r.role, r.text) for r in chat.reconstruct(log.repartition(5)).collect()), key=str)
    assert got == sorted(((c or 0, t, r, x or "") for c, t, r, x in rows), key=str)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\>n\n sim_end", max_size=12), min_size=1, max_size=6))
def test_escapes_are_reversible(texts):
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("b"), chat.escape(F.col("t")).alias("e")).collect():
        assert r.a == r.t and r.b == r.t and "<|" not in r.e
