import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from skimmer.llm import token_file as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_parts_encode_like_whole_texts():
    code = T.Encoder(PATH)
    rng = random.Random(5)
    bits = ["the", "a", " ", "  ", "\n", "\t", " ", "　", "'s", "don't", "12", "é", "漢", "!", "...", "end.", "mid,", "é.", "²,", "a\u0301.", "5.", ".", "x.,", "<|endoftext|>", "\x1c", "\r\n", "x" * 50, ""]
    texts = ["", " ", "  ", "a", " a", "a ", "foo\n \tbar", "foo \n\n y"] + ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    got = code(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_have_the_ids_of_an_unchanged_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>. y  <|endoftext|>\n z", " <|endoftext|>, <|endoftext", "no such token, here.", "a <|endoftext|>"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [i.tolist() for i in T.Encoder(PATH)(texts)] == want
    T.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "f"))
    rows = sorted(T.read(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [w + [2] for w in want]
    assert [r.start for r in rows] == [sum(len(w) + 1 for w in want[:i]) for i in range(len(want))]


@pytest.mark.parametrize("n", [1, 2, 31, 4096, 4097, 50_000])
@pytest.mark.parametrize("kind", ["one", "skewed", "wide", "large"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"one": np.full(n, 2), "skewed": np.minimum(rng.geometric(0.3, n), 50), "wide": rng.integers(0, 50257, n), "large": rng.integers(0, 200_000, n)}[kind].astype(np.uint32)
    cut = np.array([n - n // 3, n // 3], np.int64)
    payload = T.encode(ids, [7, None], cut)
    back, names, lengths = T.decode(payload)
    assert (back == ids).all() and names == [7, None] and lengths.tolist() == cut.tolist()


def test_skewed_ids_shrink_and_damage_is_noticed():
    ids = np.minimum(np.random.default_rng(1).geometric(0.5, 100_000), 30).astype(np.uint32)
    payload = T.encode(ids, [1], np.array([len(ids)]))
    assert len(payload) < 2.4 * len(ids) / 8  # about two bits each
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        T.decode(bytes(broken))


def test_file(spark, tmp_path):
    docs = spark.createDataFrame([(3, "c c", "x"), (1, None, "y"), (None, "n", "z"), (2, "", "w"), (3, "c c", "x")], "doc_id long, text string, start string")
    T.write(docs, str(tmp_path / "f"))
    rows = sorted(T.read(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3]
    assert rows[1].n_tokens == 1 and np.frombuffer(rows[1].ids, "<u4").tolist() == [2]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    T.write(docs.limit(0), str(tmp_path / "e"))
    assert T.read(spark, str(tmp_path / "e")).count() == 0


def slow_rows(docs):
    """(doc_id, start, n_tokens, crc32) by an unchanged tokenizer, in order."""
    from tokenizers import Tokenizer

    plain, at, out = Tokenizer.from_file(PATH), 0, []
    for name, text in docs:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((name, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_plain_ids(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "river.", "é", "漢字", "x1,", "\n", "<|endoftext|>", "don't", "²"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "a " * 40_000 + "b"]
    docs = [(i * 7 - 30, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = T.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == slow_rows(docs)


@pytest.mark.parametrize("size", [3, 50, 300])
def test_documents_go_on_from_segment_to_segment(spark, tmp_path, size):
    texts = ["a b c", "", "one " * 400 + "end", None, "x", "y z " * 300, "last"]
    docs = list(enumerate(texts))
    source = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    T.write(source, str(tmp_path / "f"), size=size)
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert stored.where(f"n_tokens > {size}").count() == 0 and stored.where("begun").count() > 0
    rows = sorted(T.read(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == slow_rows(docs)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_a_block_is_decoded_alone():
    ids = np.random.default_rng(2).integers(0, 5000, 3 * T.BLOCK + 77).astype(np.uint32)
    segment = T.Segment(T.encode(ids, [1], np.array([len(ids)])))
    for b in range(segment.n_blocks):
        assert (segment.blocks(b, b + 1) == ids[b * T.BLOCK : (b + 1) * T.BLOCK]).all()


def test_joined_checksums():
    rng = random.Random(1)
    for n in (0, 1, 5, 4096, 100_001):
        a, b = rng.randbytes(37), rng.randbytes(n)
        assert T.crc32_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_a_long_text_and_a_small_cache():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    code = T.Encoder(PATH, most=500)
    code.PIECE = 1000
    texts = [" ".join(f"w{rng.randrange(3000)}" + rng.choice(["", ".", "\n", " "]) for _ in range(n)) for n in (20_000, 3, 700)]
    plain = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in code(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    T.write(docs, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).select("part").distinct().count() > 1
    assert T.read(spark, str(tmp_path / "f")).agg({"n_tokens": "sum"}).first()[0] == sum(r[2] for r in slow_rows(rows))
