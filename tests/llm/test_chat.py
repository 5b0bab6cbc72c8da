import hashlib

from hypothesis import given, settings, strategies as st

from stagecraft.llm import chat

PIECES = ["<", "</s>", "<s>", "[INST]", "[/INST]", "[", "\\", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>", " ", "\n", "a", "é", "<\\/s>"]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
roles = st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), texts)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=6))
def test_round_trip(turns):
    form = chat.Formatter(chat.Template())
    whole = "".join(s for role, text in turns for s, _ in form.segments(role, text))
    assert form.read(whole) == turns
    for role, text in turns:
        assert not any(c in form.escape(text) for c in chat.Template().controls())
        assert form.unescape(form.escape(text)) == text


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        joined = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_read_back_equals_the_input(spark):
    fenced = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", fenced), (1, 1, "assistant", fenced), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"),
            (3, 0, None, None), (None, 0, "user", "x"), (None, None, "tool", "<|end|>"), (4, 0, "assistant", ""), (5, 0, "system", "s"),
            *[(6, i, "user" if i % 2 == 0 else "assistant", "t" * (i * 10)) for i in range(400)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as segments", "'z' as valid")
    for parts in (1, 5):
        got = chat.read_back(chat.format_conversations(df.repartition(parts))).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
        assert len(got) == 7
        assert {r.conv_id for r in got if r.valid} == {1, 6}


def test_the_machine_marks_wrong_turns_and_flags_assistant_text(spark):
    df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(["system", "user", "user", "assistant", "system"])],
                               "conv_id long, turn long, role string, text string")
    got = sorted(chat.format_conversations(df).collect(), key=lambda r: r.position)
    assert [r.valid for r in got] == [True, True, False, True, False]
    assert [[s.loss for s in r.segments] for r in got] == [[False] * 3] * 3 + [[False, True, False]] + [[False] * 3]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0
