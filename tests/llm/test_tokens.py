"""Token counts and token files against whole-text encoding."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from armspan.llm import queries
from armspan.llm.sequence_files import _encoded, open_sequences, read_documents, sequence, write_sequences
from armspan.llm.token_counts import count_tokens
from armspan.llm.words import parts, token_bytes, token_lengths

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b ", "foo\n bar\n\n baz  \t x", "it's <|endoftext|> o'clock's 'tis", "ΑΣ ΣΑΣ Σ. σ",
    "İstanbul IŞIK K Å", "a\x1cb c", "...,, a.,b . c, d.\ne", "日本語 テスト 한국어", "x" * 1000 + " y",
    "é é ", " lead", " nb sp 　x", "A,B. C.", "don't. can't, THE. !!! a###. b.### 12 3.4, 5.",
]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chars", [3, 40, 10_000])
def test_words_give_the_whole_text(chars):
    for text in ODD:
        lengths = [n for part in parts(text, chars) for n in token_lengths(BYTES).values([part])[0]]
        assert sum(lengths) == len(ids_of(BYTES, text)), text
        encoder = token_bytes(WORDS)
        ids = b"".join(b for part in parts(text, chars) for b in encoder.values([part])[0])
        assert np.frombuffer(ids, encoder.id_type).tolist() == ids_of(WORDS, text), text


@pytest.mark.parametrize("chars", [3, 10_000])
def test_special_strings_match_in_their_own_case_only(chars):
    encoder = token_bytes(WORDS)
    texts = ["<|ENDOFTEXT|>", "a <|StartOfText|> B. C", "X<|EndOfText|>Y. DON'T, It", "<|endoftext|>Ab. <|ENDOFTEXT|>. D,\nE"]
    for text in texts:
        ids = b"".join(b for part in parts(text, chars) for b in encoder.values([part])[0])
        assert np.frombuffer(ids, encoder.id_type).tolist() == ids_of(WORDS, text), text


def test_counts(odd_docs, no_docs):
    found = count_tokens(odd_docs, BYTES, part_chars=1000, batch_bytes=5000).collect()
    texts = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    wanted = {(i, len(t.encode()), len(ids_of(BYTES, t))) for i, t in texts}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in found} == wanted and len(found) == 9
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert count_tokens(no_docs, BYTES).count() == 0


def test_counts_of_documents(spark, small_dir):
    found = queries.op1_token_counts(spark, small_dir).collect()
    texts = {r.doc_id: r.text for r in queries.documents(spark, small_dir).collect()}
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(ids_of(BYTES, t)) for i, t in texts.items()}


def expected(rows):
    start = 0
    for doc_id, text in rows:
        ids = [*ids_of(WORDS, text), 1]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_of_documents(spark, small_dir):
    found = sorted(tuple(r) for r in queries.op10_sequence_files(spark, small_dir).collect())
    rows = queries.documents(spark, small_dir).select("doc_id", "text").orderBy("doc_id").collect()
    assert found == list(expected(rows))


def test_files_round_trip(odd_docs, no_docs):
    files = write_sequences(odd_docs, WORDS, length=16, file_tokens=50)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(files).collect())
    assert [i for _, i, _, _ in found] == [None, 1, 1, 2, 3, 5, 6, 7, 8]
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert [(i, s, n, c) for s, i, n, c in found] == list(expected((i, texts[i]) for _, i, _, _ in found))
    whole = []
    for row in files.orderBy("start").collect():
        table = open_sequences(row.path)
        assert table.num_rows == row.n_sequences and pa.types.is_fixed_size_list(table.schema.field("ids").type)
        for number in range(table.num_rows):
            ids, mask = sequence(table, number)
            assert len(ids) == len(mask) == 16
            whole += ids[mask.to_numpy(zero_copy_only=False)].tolist()
    assert whole == [x for _, i, _, _ in found for x in [*ids_of(WORDS, texts[i]), 1]]
    assert read_documents(write_sequences(no_docs, WORDS)).count() == 0


def test_short_texts_are_encoded_together():
    """Few calls of the tokenizer for many short texts; order, long texts and ids stay."""
    encoder, whole = token_bytes(WORDS), Tokenizer.from_file(WORDS)
    calls = []

    class Counted:
        def values(self, texts):
            calls.append(len(texts))
            return encoder.values(texts)

    rows = [{"doc_id": i, "text": text} for i, text in enumerate([*ODD, None, "a long text. " * 90, *ODD * 4])]
    found = [(i, b"".join(ids)) for i, ids in _encoded(iter(rows), Counted(), part_chars=1100, batch_chars=600)]
    assert [i for i, _ in found] == list(range(len(rows)))
    for (_, ids), row in zip(found, rows, strict=True):
        wanted = whole.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, encoder.id_type).tolist() == wanted
    assert sum(calls) >= len(rows) > 3 * len(calls)


def test_lost_attempts_are_not_read(spark, odd_docs):
    files = write_sequences(odd_docs.where("doc_id = 8"), WORDS)
    row = files.first()
    open(row.path.removeprefix("file:").replace("000000-", "000000-0"), "wb").write(b"half a file")
    assert read_documents(files).select(F.sum("n_tokens")).first()[0] == row.n_tokens
