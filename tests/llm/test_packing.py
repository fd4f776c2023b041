import collections
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brinelink.llm.common import table
from brinelink.llm.packing import pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def verify(pairs, got, window=2048):
    """Every id in exactly one piece, checksums right, windows gapless."""
    left = collections.defaultdict(collections.Counter)
    for i, t in pairs:
        left[i][tuple(TOK.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    per_doc = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in got:
        per_doc[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(per_doc) == set(left)
    for i, texts in left.items():
        expected = collections.Counter()
        for ids, times in texts.items():
            pass
        total = sum(len(ids) * times for ids, times in texts.items())
        assert sum(r.length for r in per_doc[i]) == total
        if sum(texts.values()) == 1:
            (ids,) = texts
            at = 0
            for r in sorted(per_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                part = ids[at : at + r.length]
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += r.length
            assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(windows) == list(range(len(windows)))
    return windows


ODD = ["", None, " ", "  two  spaces \n\n x ", "a \x00b \x00", "<|endoftext|> x <|endoftext|>", "é́ 漢字   y", "w " * 5000, "z" * 9000, "x\n y\t z   q 's 'll"]


def test_odd_texts(docs_of):
    pairs = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD)] + [(2, " ", "s1"), (2, " ", "s1"), (None, "n o id", None)]
    verify([p[:2] for p in pairs], pack(docs_of(pairs), PATH).collect())


def test_empty_table(docs_of):
    assert pack(docs_of([(1, "x")]).where("false"), PATH).count() == 0


def test_whole_table_little_padding_and_mixture(spark, sf):
    docs = table(spark, sf, "documents").repartition(4)
    got = pack(docs, PATH).collect()
    windows = verify([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], got)
    total = sum(r.length for r in got)
    assert len(windows) * 2048 < total * 1.12 + 3 * 2048
    # the share of a source within the first w windows never strays by more than a slot or two
    slots = [r for r in got if r.sequence_id < 0.8 * total / 2048]
    share = collections.Counter()
    for r in got:
        share[r.source] += r.length / total
    for w in range(1, max(r.sequence_id for r in slots) + 1, 7):
        seen = collections.Counter()
        for r in slots:
            if r.sequence_id < w:
                seen[r.source] += r.length
        for s, p in share.items():
            assert abs(seen[s] - p * w * 2048) < 4 * 128 + 0.05 * p * w * 2048


def test_targets(docs_of):
    pairs = [(i, "word " * 600, "a" if i % 4 == 0 else "b") for i in range(64)]
    got = pack(docs_of(pairs), PATH, targets={"a": 0.5, "b": 0.5}).collect()
    verify([p[:2] for p in pairs], got)
    first = [r for r in got if r.sequence_id < 4]
    assert sum(r.length for r in first if r.source == "a") == pytest.approx(4 * 1024, abs=256)


def test_new_words_are_coded_many_at_a_time(monkeypatch):
    from brinelink.llm import packing, token_counts

    spec = open(PATH, encoding="utf-8").read()
    real, given = token_counts.tokenizer_of(spec), []

    class Counting:
        get_vocab = real.get_vocab

        def encode_batch_fast(self, texts, **how):
            given.append(len(texts))
            return real.encode_batch_fast(texts, **how)

    monkeypatch.setattr(packing, "tokenizer_of", lambda spec: Counting())
    packing._ids.clear()
    words = [f"{a}{b}{c}{d}" for a in "Kéßk" for b in "漢eioǆ" for c in "xaªb" for d in ("", "rst", "ﬁ", "ё")]
    texts = [" ".join(words[i::7]) + end for i, end in enumerate([",", ".\nOr", "!\n\nx", "'s ", "\n", "\x00", " <|endoftext|>."])]
    texts += [f"{w}.\n{w}, {w}'s" for w in words]
    ids = packing.text_ids(texts, spec)
    expected = [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in ids] == expected
    assert sum(given) < 2.5 * len(words)  # the first words of texts are coded singly, and so are oddities


def test_vocabulary_without_marks_for_spaces():
    from tokenizers import models, pre_tokenizers

    from brinelink.llm import packing

    plain = Tokenizer(models.WordLevel({"ab": 0, "c": 1, "?": 2}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    assert packing.text_ids(["c ab ab d"], plain.to_str()) == [struct.pack("<4I", 1, 0, 0, 2)]
