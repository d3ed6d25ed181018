import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bpe, token_codes

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


ODD = ["", " ", "a", "aaaa aaa", "Hello  World's 123 <|endoftext|>x é", "<|ENDOFTEXT|> <|startoftext|>", "İΣς straße ẞ", "it's IT'S 't 'ta o'reilly", "a b c\x1cd\x85e", "x×y ÷ ²³½1é,“q”!!", "é Å ﬁ \U0001f600\U0001f600", "9" * 50 + "!" * 300 + "ab" * 500, "กำ مرحبا 你好", "tab\tnl\nff\x0c\x0b\r."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.text(alphabet="abeinth'<|>s.,!1é×² İ́", max_size=40)), min_size=1, max_size=6))
def test_encoders_agree_with_the_library(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB) if not hasattr(test_encoders_agree_with_the_library, "t") else test_encoders_agree_with_the_library.t
    test_encoders_agree_with_the_library.t = tok
    tables, words = bpe.coder(VOCAB)
    for column in (words.column(pa.array(texts)), token_codes.library_cache(VOCAB).column(pa.array(texts))):
        ids, o = column
        for t, a, b in zip(texts, o, o[1:]):
            want = tok.encode(t, add_special_tokens=False).ids
            assert ids[a:b].tolist() == want, t
            assert tables.decode(ids[a:b]).decode() == tok.decode(want, skip_special_tokens=False)


@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=1500), st.sampled_from([8, 16]))
@settings(max_examples=60, deadline=None)
def test_codes_give_random_access(ids, bits):
    x = np.array(ids, np.uint32)
    shard = token_codes.Shard(token_codes.shard_bytes([7, None], [x[: len(x) // 2], x[len(x) // 2 :]], bits))
    assert shard.decode().tolist() == ids
    for i in range(0, len(ids), 7):
        assert shard[i] == ids[i]
    assert shard.offsets.tolist() == [0, len(x) // 2, len(x)]


def rows(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_token_files(spark, library):
    texts = [*ODD, None, "same", "same"]
    got = sorted(token_codes.read_token_files(token_codes.write_token_files(rows(spark, texts), VOCAB)).collect())
    start = 0
    for i, (t, r) in enumerate(zip(texts, got)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.middle_id) == (i, start, len(ids), zlib.crc32(ids.tobytes()), ids[len(ids) // 2])
        start += len(ids)
    assert token_codes.read_token_files(token_codes.write_token_files(rows(spark, []), VOCAB)).count() == 0


class Counted:
    """An open file that counts what is read."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def seek(self, *at):
        return self.file.seek(*at)

    def read(self, n):
        self.n += n
        return self.file.read(n)


@pytest.mark.parametrize("bits", [8, 16])
def test_token_files_are_addressable(spark, library, tmp_path, monkeypatch, bits):
    """Any token of a file on disk by a few bytes, without decoding anything."""
    monkeypatch.setattr(token_codes, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(token_codes, "FILE_SHARDS", 3)
    texts = [" ".join(["the", "quick", "zyx", str(i)][: 1 + i % 4] * (1 + i * 7 % 300)) for i in range(200)]
    table = rows(spark, texts).repartition(3)
    found = token_codes.write_token_files(table, VOCAB, chunk_bits=bits, path=str(tmp_path / "tokens"))
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    everything = np.concatenate(want)
    by_file = {}
    for r in found.collect():
        shards = list(token_codes.shards_of(r.content))
        by_file[r.path.removeprefix("file:")] = (shards[0].part, shards[0].before, [s.decode() for s in shards])
    order = sorted(by_file, key=lambda p: by_file[p][:2])
    assert np.concatenate([x for p in order for x in by_file[p][2]]).tolist() == everything.tolist() and len(order) > 3
    at = 0
    for p in order:
        with open(p, "rb") as f:
            file = Counted(f)
            tokens = token_codes.TokenFile(file)
            for i in [0, len(tokens) - 1, *range(5, len(tokens), 997)]:
                file.n = 0
                assert tokens[i] == everything[at + i]
                assert file.n < 150
            at += len(tokens)
    assert at == len(everything)


def test_token_files_odd_rows(spark, library, monkeypatch):
    lines = [(None, "b c"), (3, "x y"), (3, "x y"), (3, "other"), (3, None), (-2, ""), (9, "word " * 3000)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in lines], "doc_id long, text string, tie int, `row` int, `a.b` int").repartition(4)
    got = sorted(token_codes.read_token_files(token_codes.write_token_files(table, VOCAB)).collect(), key=lambda r: r.start)
    key = lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64))
    monkeypatch.setattr(token_codes, "local_path", lambda path: None)
    assert sorted(token_codes.read_token_files(token_codes.write_token_files(table, VOCAB)).collect(), key=lambda r: r.start) == got
    start = 0
    for (d, t), r in zip(sorted(lines, key=key), got, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_bpe_round_trip(spark, library):
    texts = [*ODD, None]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows(spark, texts), VOCAB), VOCAB).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert hashlib.sha256(got[i].ids).digest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest()
        assert got[i].text == library.decode(ids, skip_special_tokens=False)
    assert sorted(bpe.round_trip(rows(spark, texts), VOCAB).collect()) == sorted(got.values())
    assert bpe.encode(rows(spark, []), VOCAB).count() == 0


SCRIPTS = ["abcdefghij", "абвгдежз", "你好世界", "กำมรั", "!?.-", "a", "éèüß", "éä", "xyz؀ "]


@pytest.mark.parametrize("long", [0, 6, 1 << 20])
def test_long_words_of_any_script(library, monkeypatch, long):
    """Merged by rank or by round, with words of many scripts in one call."""
    monkeypatch.setattr(bpe, "LONG", long)
    rng = np.random.default_rng(long)
    words = ["".join(rng.choice(list(s), n)) for s in SCRIPTS for n in (1, 2, 3, 7, 40, 600)] + ["<|endoftext|>", "a<|endoftext|><|startoftext|>б", "the" * 300, "a" * 2001]
    words = [w for w in words if w]
    got = bpe.coder(VOCAB)[0].encode_words(words)
    for w, b in zip(words, got):
        assert np.frombuffer(b, "<u4").tolist() == library.encode(w, add_special_tokens=False).ids, w
    assert bpe.coder(VOCAB)[0].encode_words([]) == []


def test_bpe_odd_rows(spark, library):
    texts = [None, "", "same", "same", "при́вет " * 50, "w" * 40_000]
    table = spark.createDataFrame([(None if i < 2 else 7, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids int, `a.b` int")
    got = sorted((r.doc_id or -1, r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in bpe.round_trip(table, VOCAB).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i < 2 else 7, library.decode(ids, skip_special_tokens=False), ids))
    assert got == sorted(want)
    assert bpe.round_trip(table.limit(0), VOCAB).count() == 0
