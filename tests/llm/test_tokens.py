import functools
import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  a  b", "It's we'll 'RE they'd", "naïve ÉCOLE Straße ΣΟΦΟΣ İstanbul", "a<|endoftext|>b <|startoftext|> c", "1234 ٣٤ ½ ²",
       "日本語 テキスト 🙂🙂", "x" * 700, "ab " * 400, "\x1c\x1d \x85z", "é combined", "!!!???...", "\u0000 nul", "don''t 's's"]


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    return ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()


def test_word_bpe_equals_the_library(texts):
    ours, theirs = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text[:80]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_counts_equal_the_library(texts):
    ours, theirs = token_counts.PrefixCounter(BYTE), Tokenizer.from_file(BYTE)
    for text in texts:
        assert ours.count(text) == len(theirs.encode(text, add_special_tokens=False).ids), text[:80]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cn", "Cs")), max_size=60))
def test_any_text(text):
    assert _dp().count(text) == len(_byte().encode(text, add_special_tokens=False).ids)
    assert _ours().encode(text) == _word().encode(text, add_special_tokens=False).ids


@functools.cache
def _byte():
    return Tokenizer.from_file(BYTE)


@functools.cache
def _dp():
    return token_counts.PrefixCounter(BYTE)


@functools.cache
def _ours():
    return bpe.WordBpe(WORD)


@functools.cache
def _word():
    return Tokenizer.from_file(WORD)


def test_every_prefix_is_exact():
    ours, theirs = token_counts.PrefixCounter(BYTE), _byte()
    for text in ("internationalization", " unbelievable", "antidisestablishmentarianism", "thethethethe"):
        for i, c in enumerate(ours.prefixes(text.encode())):
            assert c == len(theirs.encode(text[:i], add_special_tokens=False).ids)


def _every_prefix(text):
    counts = token_counts.prefix_counts(_dp().index(text))
    assert len(counts) == len(text) + 1
    for k, c in enumerate(counts.tolist()):
        assert c == len(_byte().encode(text[:k], add_special_tokens=False).ids), (text[:k], k)


@pytest.mark.parametrize("text", [t for t in ODD if len(t) < 100] + ["a  b\n\n c   <|endoftext|>d", "!<|endoftext|>\t\t<|endoftext|>", "we're 'rest they've'll ''ll", "x <| y <|endoftext| z"])
def test_index_is_exact_at_every_prefix(text):
    _every_prefix(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'re", "'l", "'", "a", "the", "é", "日本", "1", "!?", "<|endoftext|>", "<|", "\u3000", "--------"]), max_size=14).map("".join))
def test_index_is_exact_at_every_prefix_of_odd_texts(text):
    _every_prefix(text)


def test_budgets_are_looked_up():
    text = "Some words that are countedéé in préfixes.  \n And more. " * 5
    counts = token_counts.prefix_counts(_dp().index(text))
    each = [len(_byte().encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    budgets = tuple(range(0, 90, 7))
    assert token_counts.longest_within(counts, budgets) == [max(k for k, c in enumerate(each) if c <= b) for b in budgets]


def test_scan_and_heap_agree():
    merges = bpe.WordBpe(WORD)
    for word in ("antidisestablishment", "aaaaaaaaaaaaaaaaaaaaaa", "hahahahahathethethe"):
        symbols = [*(merges.symbol[b] for b in word.encode()[:-1]), merges.ending[word.encode()[-1]]]
        assert merges.merges._scan(symbols) == merges.merges._heap(symbols)


def test_queries(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (None, "", "z"), (1, "Hello world", "x"), (4, "word " * 2000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(token_counts.token_counts(docs, BYTE).collect(), key=str)
    assert len(found) == 5
    by = {r["doc_id"]: r for r in found}
    stored = token_counts.prefix_index(docs, BYTE)
    assert {r["doc_id"]: r["fits"] for r in token_counts.answers(stored, (3, 0, 5000)).collect()}[4] == [14, 0, 10_000]
    assert by[4]["fits"] == [128 * 5 - 1, 512 * 5 - 1, 10_000] and by[2]["fits"] == [0, 0, 0]
    assert by[2]["n_tokens"] == 0 and not by[2]["over_limit"] and by[4]["over_limit"] and by[4]["n_bytes"] == 10_000
    out = {r["doc_id"]: r for r in bpe.digest_documents(docs, WORD).collect()}
    ids = _word().encode("Hello world", add_special_tokens=False).ids
    assert out[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert out[2]["n_tokens"] == 0 and out[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    coded = bpe.encode_documents(docs, WORD)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, WORD).collect()}[1] == _word().decode(ids, skip_special_tokens=False)
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0
