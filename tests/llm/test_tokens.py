"""op3 and op5 against the public libraries."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest

from pressglass.llm import bpe, planes, pretokens

SF = "/root/testdata/sf0.001"
TRICKY = ["", None, " ", "\n", "a", "  a", "a  ", " \n\n b", "it's we're I'll 'tis ''s 's' 're'l x'd'm", "a'sb 'stuff 'Re  x   y", "é̀ ünï 日本語 १२३ 🙂🙂 ١٢", "x" * 3000 + " " * 3000 + "!?" * 2000, "aaa\t\t\tb\r\n\r\n c", "\x00\x1c\x1f a\x85b", "<|endoftext|> x", "don't 'v 'l 'll 'v"]


def reference():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    noise = ["".join(rng.choices("ab '\n\tstredlvm1é!", k=rng.randint(0, 60))) for _ in range(500)]
    return list(enumerate([*docs, *TRICKY, *noise]))


def test_words_are_the_patterns_matches():
    import regex

    find = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}")).findall
    rng = random.Random(7)
    texts = [t or "" for t in TRICKY] + ["".join(rng.choices("ab '\n\tstredlvm1é!　", k=rng.randint(0, 40))) for _ in range(3000)]
    words, rows = pretokens.split_words(texts)
    words = [w.decode() for w in words.to_pylist()]
    for i, t in enumerate(texts):
        assert words[rows[i] : rows[i + 1]] == find(t), repr(t)


def test_encode_decode(spark):
    own = rows_of(spark)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in [*own, own[0], (None, "null id")]], "doc_id long, text string, words string, raw string")
    enc = reference()
    got = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True, with_text=True).collect()
    assert len(got) == len(own) + 2
    texts = dict(own) | {None: "null id"}
    for r in got:
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids, repr(text[:80])
        assert r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    assert planes.round_trip(none, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_long_words_equal_the_definition():
    t = bpe.Transducer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), max_states=500)
    rng = random.Random(3)
    for alphabet in (b"a", b"ab", b"=- ", b"etaoin shr", bytes(range(256))):
        word = bytes(rng.choices(alphabet, k=2500))
        assert list(t.encode(word)) == [t.ranks[x] for x in t.merge(word)]
        assert list(t.stream(word)) == list(t.encode(word))


def test_stream_decoder_by_pieces():
    _, _, tokens, _ = bpe._tables(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = reference()
    import numpy as np

    text = "é日本語🙂 plain ünï 🙂" * 5
    ids = np.array(enc.encode_ordinary(text), np.uint32)
    for size in (1, 2, 3, 1000):
        decoder = bpe.StreamDecoder(tokens)
        parts = [decoder.push(ids[i : i + size]) for i in range(0, len(ids), size)]
        decoder.finish()
        for p in parts:
            p.decode()  # every piece ends between characters
        assert b"".join(parts).decode() == text
    broken = np.array([enc.encode_single_token(b"\xe6")], np.uint32)
    decoder = bpe.StreamDecoder(tokens)
    assert decoder.push(broken) == b""
    with pytest.raises(UnicodeDecodeError):
        decoder.finish()
    with pytest.raises(UnicodeDecodeError):
        decoder.push(np.array([enc.encode_single_token(b"\xe6"), enc.encode_single_token(b"a")], np.uint32))


@pytest.mark.parametrize("kind", ["bytes", "bits"])
def test_id_planes(spark, kind):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = rows_of(spark)
    docs = spark.createDataFrame([(i, x, "z") for i, x in own], "doc_id long, text string, path string").repartition(3)
    got = planes.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, kind).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(got, own, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc), repr(text)
        start += len(ids)


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    from pressglass.llm.queries import op5_id_planes

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b", "<|endoftext|>", "before<|endoftext|> after <|endoftext|>", "<|endoftext |>", None, "", "it's last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, start = op5_id_planes(spark, str(tmp_path)).orderBy("doc_id").collect(), 0
    for r, text in zip(got, texts, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))), repr(text)
        start += len(ids)


def test_planes_of_blocks():
    import io

    import numpy as np

    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 32, 1000, dtype=np.uint32)
    for kind in planes.KINDS:
        assert (planes.from_planes(planes.to_planes(ids, kind), 1000, kind) == ids).all()
        out = io.BytesIO()
        writer = planes.PlaneWriter(out, kind, block=64)
        writer.add([3, None], np.array([700, 0]), ids[:700])
        writer.add([5], np.array([300]), ids[700:])
        writer.close()
        reader = planes.PlaneReader(out, len(out.getvalue()))
        assert [len(reader.block(i)) for i in range(len(reader.blocks))] == [64] * 15 + [40]
        docs = [np.concatenate([np.zeros(0, np.uint32), *p]) for _, p in reader.documents()]
        assert [len(d) for d in docs] == [700, 0, 300] and (np.concatenate(docs) == ids).all()
