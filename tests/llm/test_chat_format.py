import random

from pyspark.sql import functions as F

from strandworks.llm import chat_format as C


def brute_parse(s):
    """A plain parser of the grammar."""
    out = []
    while s:
        assert s.startswith("### ")
        role, s = s[4:].split(": ", 1)
        end = s.index("\n</turn>\n")
        body, s = s[:end], s[end + len("\n</turn>\n") :]
        text, i = "", 0
        while i < len(body):
            k = i
            while body[k : k + 1] == "\\":
                k += 1
            if any(body.startswith(x, k) for x in ("### ", "</turn>")):
                assert k > i
                text += body[i + 1 : k] + body[k]
                i = k + 1
            else:
                text += body[i : max(k, i + 1)]
                i = max(k, i + 1)
        out.append((role, text))
    return out


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(3)
    parts = ["### ", "</turn>", "\n", "\\", "\\\\", "\n</turn>\n", "### user: ", "a", " ", "é🙂", "###", "</turn", "$1", ": "]
    texts = [None, "", "\\", "\n</turn>", "\\### Assistant: </turn> ok"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(400)]
    rows = [(i // 5, i % 5, r.choice(["user", "assistant"]), t, "x") for i, t in enumerate(texts)]
    chats = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string"))
    got = chats.withColumn("loss", C.loss_texts(F.col("formatted"), F.col("loss_spans"))).withColumn("p", C.parse(F.col("formatted"))).collect()
    for g in got:
        want = [(role, t or "") for c, _, role, t, _ in rows if c == g.conv_id]
        assert brute_parse(g.formatted) == want == [tuple(x) for x in g.p]
        assert g.loss == [t for role, t in want if role == "assistant"] and g.n_turns == len(want)


def test_odd_rows(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(1, None, "user", "b"), (1, 0, None, "c"), (1, 0, "role with: colon\n", "d"), (1, 0, None, "c"), (None, 1, "assistant", "w " * 20_000)]
    got = {g.conv_id: g for g in C.format_chats(spark.createDataFrame(rows, schema)).withColumn("p", C.parse(F.col("formatted"))).collect()}
    assert [tuple(x) for x in got[1].p] == [("user", "b"), ("", "c"), ("", "c"), ("role with: colon\n", "d")] and got[None].n_turns == 1
    assert C.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_parser_refuses_what_breaks_the_grammar(spark):
    bad = ["x", "### user: a", "### user: a\n</turn>\nmore", "user: a\n</turn>\n", "### user: a ### b\n</turn>\n", "### user: a </turn> b\n</turn>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "s string")
    assert [r[0] for r in df.select(C.parse(F.col("s"))).collect()] == [None] * len(bad)
