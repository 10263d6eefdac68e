import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rarespark.llm.chat import CONTROLS, conversation_digests, escape, format_conversations, marked_turns, read_turns, render_part, unescape

PIECE = st.one_of(st.sampled_from([*CONTROLS, "\\", "\n", "<", "|", "[", "<|im_", "end|>", "INST]"]), st.text(max_size=5))
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_escape_is_reversible_and_leaves_no_control(text):
    assert unescape(escape(text)) == text
    assert not any(control in escape(text) for control in CONTROLS)


@settings(max_examples=200, deadline=None)
@given(turns=st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_turns_are_read_back(turns):
    assert read_turns(marked_turns(turns)) == turns


@settings(max_examples=100, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), min_size=1, max_size=6))
def test_spans_hold_the_texts(turns):
    text, spans, rewrites = render_part(marked_turns, [], turns, 0)
    assert text == marked_turns(turns) and not rewrites and len(spans) == len(turns)
    for (role, said), span in zip(turns, spans):
        assert span["loss"] == (role == "assistant")
        if span["loss"]:
            assert unescape(text[span["text_start"] : span["text_end"]]) == said


def last_only(turns, before=0):
    """Hides all answers but the last."""
    shown = [(r, t if r != "assistant" or k == len(turns) - 1 else "...") for k, (r, t) in enumerate(turns)]
    return "".join(f"[{r}]{t}\n" for r, t in shown)


def test_rewriting_template_is_found():
    turns = [("user", "a"), ("assistant", "first"), ("user", "b"), ("assistant", "second")]
    text, spans, rewrites = render_part(last_only, [], turns, 0)
    assert rewrites
    masked = [text[s["text_start"] : s["text_end"]] for s in spans if s["loss"]]
    assert masked == ["second"]


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok"), (1, 2, None, None), (None, 0, "user", "x"), (None, None, "assistant", "no turn"),
    (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"), (3, 5, "user", ""),
] + [(4, t, "assistant" if t % 2 else "user", f"turn {t}\n<|im_end|>") for t in range(40)]


def brute(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        said = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(marked_turns(turns)), False)
    return out


@pytest.mark.parametrize("part_turns", [64, 8, 3])
def test_digests_against_brute_force(spark, part_turns):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS part", "2 AS _ctx")
    got = {r[0]: tuple(r[1:]) for r in conversation_digests(format_conversations(df, part_turns=part_turns)).collect()}
    assert got == brute(ROWS)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_digests(format_conversations(df)).count() == 0


LONG = [(7, 3 * t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(130)]


def test_rewriting_template_is_rendered_on_the_whole_conversation(spark):
    df = spark.createDataFrame(LONG, "conv_id bigint, turn bigint, role string, text string")
    (row,) = format_conversations(df, last_only).collect()
    assert (row.n_turns, row.formatted, row.rewrites_history) == (130, last_only([r[2:] for r in LONG]), True)
    assert [row.formatted[s.text_start : s.text_end] for s in row.spans if s.loss] == ["turn 129"]


def numbered(turns, before=0):
    """Each turn with its number and the text of the second turn before it."""
    return "".join(f"[{before + k} {turns[k - 2][1] if k > 1 else '-'}|{r}]{t}\n" for k, (r, t) in enumerate(turns))


numbered.look_back = 2


@pytest.mark.parametrize("part_turns", [64, 7, 1])
def test_parts_have_the_promised_turns_before_them(spark, part_turns):
    gaps = [(c, t + (1000 if t > 60 else 0), r, x) for c, t, r, x in LONG]
    df = spark.createDataFrame(gaps, "conv_id bigint, turn bigint, role string, text string")
    parts = sorted(format_conversations(df, numbered, part_turns).collect(), key=lambda r: r.part)
    assert len(parts) == -(-130 // part_turns) and "".join(r.formatted for r in parts) == numbered([r[2:] for r in LONG])
    assert not any(r.rewrites_history for r in parts)
    assert [r.formatted[s.text_start : s.text_end] for r in parts for s in r.spans if s.loss] == [f"turn {t}" for t in range(1, 130, 2)]
