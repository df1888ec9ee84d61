import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quirelens.llm import chat

SAID = "\\### Assistant: </turn> ok"
ALPHABET = st.sampled_from(["\\", "#", "### ", "</turn>", "<", "/turn>", "a", "\n", ":", "User: ", "é"])
TEXT = st.lists(ALPHABET, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=5))
def test_round_trip_and_spans(turns):
    out, spans, rewrites = chat.spans(turns)
    assert not rewrites and chat.read_back(out) == turns
    assert [chat.unescape(out[a:b]) for _, _, a, b in spans] == [t for _, t in turns]


def test_history_rewriting_is_found():
    last_only = lambda turns: "".join(f"<{r}>" + (t if k == len(turns) - 1 else "") for k, (r, t) in enumerate(turns))
    _, spans, rewrites = chat.spans([("user", "one"), ("assistant", "two")], last_only)
    assert rewrites and spans[1][0] == len("<user>")


def test_table(spark):
    rows = [(1, 1, "assistant", SAID), (1, 0, "user", SAID), (2, 0, None, None), (2, 0, None, None), (None, None, "tool", ""), (3, 5, "assistant", "x" * 50_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    assert got.keys() == {1, 2, 3, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{SAID}\nassistant\n{SAID}\n") and got[1].loss_sha256 == sha(SAID) and got[1].loss_chars == len(SAID)
    assert got[2].n_turns == 2 and got[2].turns_sha256 == sha("\n\n\n\n") and got[2].loss_chars == 0
    assert got[None].turns_sha256 == sha("tool\n\n") and got[3].loss_chars == 50_000
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_long_conversations():
    turns = [("user" if k % 2 else "assistant", f"{SAID} {k} " * (k % 5)) for k in range(300)]
    assert chat.spans(turns) == chat.spans_by_prefixes(turns, chat.render)
    numbered = lambda turns: f"{len(turns)} turns" + chat.render(turns)
    assert chat.spans(turns[:60], numbered)[2] and chat.spans(turns[:60], numbered) == chat.spans_by_prefixes(turns[:60], numbered)


def test_a_rewrite_at_one_prefix_is_found():
    def moved(turns):
        """The system text goes behind a last tool turn."""
        if turns[-1][0] != "tool":
            return chat.render(turns)
        return chat.render([t for t in turns if t[0] != "system"] + [t for t in turns if t[0] == "system"])

    turns = [("system", "rules"), *(("tool" if k == 30 else "user" if k % 2 else "assistant", f"said {k}") for k in range(1, 100))]
    found = chat.spans(turns, moved)
    assert found[2] and found == chat.spans_by_prefixes(turns, moved)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=20), st.text("ab", max_size=20))
def test_common_prefix(a, b):
    assert chat._common(a, b) == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
