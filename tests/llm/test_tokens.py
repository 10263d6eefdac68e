from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rarespark.llm.tokens import encoder

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ALPHABET = st.sampled_from(list("abcDEzé ßÉİ'st.,!?-\"0123 \n\t\r\x0b\x1c\x85\xa0  　́日本<|>"))
TEXTS = st.one_of(st.text(alphabet=ALPHABET, max_size=60), st.text(max_size=40))


@pytest.mark.parametrize("kind", FILES)
@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_pieces_give_the_library_ids(kind, text):
    code = encoder(public_tokenizers.path(FILES[kind]), kind)
    text = text.encode("utf-8", "ignore").decode()
    want = code.tokenizer.encode(text, add_special_tokens=False).ids
    assert array("I", code.encode(text)).tolist() == want if not want else code.encode(text) == array("I", want).tobytes()


@pytest.mark.parametrize("kind", FILES)
def test_ids_survive_a_full_cache(kind, monkeypatch):
    from rarespark.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 3)
    code = tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    text = "to be or not to be, that is the question: whether 'tis nobler in the mind to suffer"
    want = array("I", code.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert code.encode(text) == want == code.encode(text)


@pytest.mark.parametrize("kind", FILES)
def test_closing_marks_and_line_starts_need_no_splitter(kind, monkeypatch):
    code = encoder(public_tokenizers.path(FILES[kind]), kind)
    words = [w + m for w in ("word", "Été", "Zebra") for m in ("", ".", "...", "&&&", ",***", ".$$$", "!?%%%", "###")]
    text = "a " + " ".join(words) + "".join("\n" + w for w in words)
    want = array("I", code.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    fresh = type(code)(public_tokenizers.path(FILES[kind]), kind)
    whole, seen = fresh._whole, []
    monkeypatch.setattr(fresh, "_whole", lambda piece: seen.append(piece) or whole(piece))
    assert fresh.encode(text) == want
    assert set(seen) <= {"a"}
