from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordLevel

from rarespark.llm.token_files import ShardReader, _narrow, id_width, read_document, read_token_files, write_token_files
from tests.llm.odd import ROWS, no_documents, odd_documents, text_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [(r[0], array("I", tokenizer.encode(text_of(r), add_special_tokens=False).ids + [2]).tobytes()) for r in rows]


@pytest.mark.parametrize("repeat", [1, 6])
def test_round_trip(spark, tmp_path, repeat):
    rows = ROWS * repeat
    manifest = write_token_files(odd_documents(spark, repeat).repartition(3), str(tmp_path), PATH)
    got = read_token_files(spark, str(tmp_path), manifest).orderBy("start").collect()
    key = lambda d: (d is not None, d or 0)
    assert [key(r.doc_id) for r in got] == sorted(key(r[0]) for r in rows)
    assert sorted((key(r.doc_id), bytes(r.ids)) for r in got) == sorted((key(d), ids) for d, ids in expected(rows))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    for doc_id, ids in expected(rows):
        if doc_id in (1, 6):
            assert read_document(manifest, str(tmp_path), doc_id) == array("I", ids).tolist()
    assert read_document(manifest, str(tmp_path), 10_000) is None


def test_other_dictionary_is_refused(spark, tmp_path):
    manifest = write_token_files(odd_documents(spark, 8), str(tmp_path), PATH)
    assert (tmp_path / "dictionary").stat().st_size > 0
    with pytest.raises(ValueError, match="another dictionary"):
        ShardReader(manifest.first().path, b"something else")


def test_no_documents(spark, tmp_path):
    manifest = write_token_files(no_documents(spark), str(tmp_path), PATH)
    assert read_token_files(spark, str(tmp_path), manifest).count() == 0


def test_wide_ids_are_not_wrapped(spark, tmp_path):
    manifest = write_token_files(odd_documents(spark), str(tmp_path), PATH, end_id=70_000)
    got = read_token_files(spark, str(tmp_path), manifest).collect()
    assert got and {array("I", bytes(r.ids))[-1] for r in got} == {70_000}


def test_width_follows_the_tokenizer_file(tmp_path):
    path = str(tmp_path / "large.json")
    Tokenizer(WordLevel({f"w{i}": i for i in range(70_000)}, "w0")).save(path)
    assert id_width(path, 2) == 4 and id_width(PATH, 2) == 2 and id_width(PATH, 2, 1 << 17) == 4
    with pytest.raises(ValueError, match="does not fit"):
        _narrow(array("I", [1, 65_536]).tobytes(), 2)
