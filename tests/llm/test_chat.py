import random

from marketloom.llm import chat


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    text = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        at, out = 0, []
        for r, t in turns:
            head = at + len(r) + 5
            at = head + len(t) + 8
            if r == "assistant":
                out.append((head, at))
        return out

    return n, text(chosen[:n]), text(chosen[n:]), text(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


def test_against_plain_code(spark):
    rng = random.Random(1)
    turn = lambda: (rng.choice(["user", "assistant", "system", ""]), rng.choice(["a", "é\n", "", "long " * 400, "\U0001f600"]))
    pairs = []
    for i in range(120):
        head = [turn() for _ in range(rng.randint(0, 4))]
        pairs.append((i, head + [turn() for _ in range(rng.randint(0, 3))], head + [turn() for _ in range(rng.randint(0, 3))], "x"))
    pairs.append((120, None, [("user", "q")], "x"))
    df = spark.createDataFrame(pairs, f"i int, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string")
    rows = chat.preference_format(df).collect()
    assert len(rows) == 121
    for r in rows:
        c, j = ([tuple(t) for t in (pairs[r.i][k] or [])] for k in (1, 2))
        got = (r.common_turns, r.prompt, r.chosen_completion, r.rejected_completion, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask])
        assert got == plain(c, j)
        for s in r.chosen_mask:
            assert r.chosen_completion[s.start : s.end].endswith("<|end|>\n")


def test_conversations_and_pairs(spark, tmp_path):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "short"), (1, 1, "assistant", "a longer one"), (1, 0, "user", "q"),
        (2, 0, "user", "alone"), (4, 0, "user", None), (4, 0, None, "x"), (5, None, "user", "n"), (5, 0, "user", "n"), (5, 0, "user", "n"), (None, 0, "user", "lost"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.chosen_id: r for r in chat.op7_chat_formatting(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 4]
    assert got[1].rejected_id == 0 and got[1].common_turns == 1 and got[1].prompt == "<|user|>\nq<|end|>\n"
    assert got[1].chosen_mask == "14:34"
    assert got[4].common_turns == 0 and got[4].chosen_completion == "<||>\nx<|end|>\n<|user|>\n<|end|>\n"
    assert got[4].rejected_completion.count("<|user|>") == 3
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.pair_by_id(chat.conversations(empty)).collect() == []
