import collections

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brinelink.llm.common import table
from brinelink.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def truth(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def rows(df):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in df.collect())


def want(pairs):
    return collections.Counter((i, len((t or "").encode()), truth(t)) for i, t in pairs)


ODD = [
    "",
    None,
    " \n\t ",
    "ends with <|endoftext|> inside",
    "a<|startoftext|>b<|endof",
    "It's they'll 12345 1,000.5 ...!!",
    "İSTANBUL ΣΑΣ Ǆ ﬁ é ́x",
    "漢字かな交じり文 " * 40,
    "x y z\x1cq\x85r",
    "a" * 3000,
    "!" * 2000 + "word" * 700,
    "   ".join(["many", "spaces"] * 300),
    "<|endoftext|>" * 200,
    "é́" * 900,
    "1234567890" * 300,
]


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (256, 32), (1000, 100), (32768, 256)])
def test_equals_the_library_on_odd_texts(docs_of, chunk, overlap):
    pairs = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[9]), (None, ODD[9]), (7, ODD[9])]
    assert rows(token_counts(docs_of(pairs), PATH, chunk_chars=chunk, overlap_chars=overlap)) == want(pairs)


def test_chunks_are_spliced(docs_of):
    text = "some plain words, and numbers like 1234. " * 400
    got = token_counts(docs_of([(1, text)]), PATH, chunk_chars=1000, overlap_chars=60).first()
    assert got.n_tokens == truth(text) and got.n_chunks == 17


def test_empty_table(docs_of):
    assert token_counts(docs_of([(1, "x")]).where("false"), PATH).count() == 0


@pytest.mark.parametrize("chunk", [2000, 32768])
def test_whole_table(spark, sf, chunk):
    docs = table(spark, sf, "documents")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows(token_counts(docs, PATH, chunk_chars=chunk)) == want(pairs)
