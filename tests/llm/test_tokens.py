import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import separators, token_files
from tidemark.llm.tokens import Block, Encoder, WordTable

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)  # as it comes: strings of special tokens become these
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
ENCODER = Encoder(PATH, 2, memo=50)
TEXT_ENCODER = Encoder(PATH, 2, memo=50, special_as_text=True)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z1\n\t .,'sÉß　中́\x1c\x85😀<|>")) | st.text() | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "\n", "<|end", "É"])).map("".join))
def test_memo_equals_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    for encoder, library in ((ENCODER, LIBRARY), (TEXT_ENCODER, PLAIN)):
        expected = encoder.pack(library.encode(text, add_special_tokens=False).ids + [2])
        assert encoder(text) == expected and encoder.batch(pa.array([text]))[0] == expected


def test_strings_of_special_tokens():
    assert ENCODER("a <|endoftext|> b") == ENCODER.pack([64, 220, 50256, 275, 2])
    assert 50256 not in np.frombuffer(TEXT_ENCODER("a <|endoftext|> b"), "<u2")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab  Z1\n\t.,'sÉß　中😀"), max_size=40), max_size=8))
def test_batches_equal_single_texts(texts):
    array = pa.array([None, *texts], pa.string())
    for part in (array, array.slice(1)):
        assert ENCODER.batch(part) == [ENCODER(t) for t in part.to_pylist()]
        assert all(isinstance(x, bytes) for x in ENCODER.batch(part))


def test_word_table_starts_anew_and_keeps_colliding_words_apart(monkeypatch):
    monkeypatch.setattr(WordTable, "FULL", 40)
    monkeypatch.setattr(WordTable, "SLOTS", 1 << 21)
    encoder = Encoder(PATH, 2)
    texts = [" ".join(f"w{i * j % 31}" for j in range(1, 30)) for i in range(60)]
    assert encoder.batch(pa.array(texts)) == [ENCODER(t) for t in texts]
    monkeypatch.setattr(Block, "keys", lambda self: self.sizes.astype(np.uint64))  # all words of a length agree in the hash
    one_hash = Encoder(PATH, 2)
    assert one_hash.batch(pa.array(texts[:3])) == [ENCODER(t) for t in texts[:3]]
    long = "a " + "b" * 300 + " c"
    assert encoder.batch(pa.array([long, "a b", long])) == [ENCODER(t) for t in (long, "a b", long)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    lib = Tokenizer.from_file(path)
    e = Encoder(path, 2)
    for text in ("Hello  World, it's 12!", " x ", "<|endoftext|> a"):
        assert e(text) == e.pack(lib.encode(text, add_special_tokens=False).ids + [2])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=400))
def test_elias_fano(values):
    values = np.sort(np.array(values))
    ef = token_files.EliasFano.encode(values)
    assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(ef.n)]
    with pytest.raises(IndexError):
        ef.select(ef.n)


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 700))
    ef = token_files.EliasFano.encode(values)
    assert 8 * (len(ef.low) + len(ef.high) + len(ef.directory)) < 10_000 * (np.log2(700) + 3)


def ids(text, library=LIBRARY):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_are_told_apart_by_their_bytes():
    words = [b"a", b"a\0", b"\0a", b"abcdefgh", b"abcdefg", b"abcdefgh\0", b"x" * 255, b"x" * 254]
    joined = b" ".join(words) + b" "
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    block = Block(joined, ends - [len(w) for w in words], np.array([len(w) for w in words]))
    assert len(set(block.keys().tolist())) == len(words)
    table = WordTable(lambda w: np.array([len(w)], "<u2").tobytes(), np.dtype("<u2"))
    for _ in range(2):
        got, edges = table.look_up(joined, ends - [len(w) for w in words], ends)
        assert got.tolist() == [len(w) for w in words] and edges.tolist() == list(range(9))
    assert table.n == len(words)


@pytest.mark.parametrize("block", [1 << 19, 1000])
def test_files_round_trip(spark, make_docs, odd, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block)
    path = f"{tmp_path}/t{block}"
    odd = [*odd, (20, "an end <|endoftext|> inside")]
    token_files.write_token_files(make_docs(odd), path, PATH)
    found = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted([i for i, _ in odd], key=lambda i: (i is not None, i))
    start = 0
    texts = {}
    for i, t in odd:
        texts.setdefault(i, []).append(t)
    for r in found:
        whole = ids(texts[r.doc_id].pop()) + [2]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(whole), whole)
        assert r.ids_crc32 == zlib.crc32(np.array(whole, "<u4").tobytes())
        start += len(whole)


def test_files_of_an_empty_table(spark, make_docs, tmp_path):
    token_files.write_token_files(make_docs([]), f"{tmp_path}/e", PATH)
    assert token_files.read_token_files(spark, f"{tmp_path}/e").count() == 0
    separators.write_flat_files(make_docs([]), f"{tmp_path}/f", PATH)
    assert separators.count_tokens(separators.read_flat_files(spark, f"{tmp_path}/f")[0]).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_separator_scan(spark, make_docs, odd, tmp_path, block):
    rows = [*(odd if block > 7 else odd[:5] + odd[6:]), (20, "an end <|endoftext|> inside")]
    path = f"{tmp_path}/s{block}"
    separators.write_flat_files(make_docs(rows), path, PATH, block_tokens=block)
    blocks, names = separators.read_flat_files(spark, path)
    found = names.join(separators.count_tokens(blocks), ["shard", "ordinal"]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(i), len(ids(t, PLAIN))) for i, t in rows)
    assert all(r.closed for r in found)


def test_separator_scan_of_raw_blocks(spark):
    # 1 1 E | E 2 | 3 3 | 4 E 5: a document over three blocks, an empty one, one that isn't closed
    e = 9
    data = [(0, 0, [1, 1, e]), (0, 1, [e, 2]), (0, 2, [3, 3]), (0, 3, [4, e, 5]), (1, 0, [7])]
    blocks = spark.createDataFrame([(s, b, 2, bytearray(np.array(x, "<u2").tobytes())) for s, b, x in data], "shard int, block int, width int, ids binary")
    found = [tuple(r) for r in separators.count_tokens(blocks, end_id=e).orderBy("shard", "ordinal").collect()]
    assert found == [(0, 0, 0, 2, True), (0, 1, 3, 0, True), (0, 2, 4, 4, True), (0, 3, 9, 1, False), (1, 0, 0, 1, False)]


def test_raw_id_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    expected = {}
    for name in ("a", "b", "empty"):
        ids = rng.integers(0, 6, 0 if name == "empty" else 1000).astype("<u4")
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        sizes, n = [], 0
        for x in ids.tolist():
            if x == 5:
                sizes.append((n, True))
                n = 0
            else:
                n += 1
        expected[name] = sizes + [(n, False)] * bool(n)
    for block in (7, 1 << 18):
        found = separators.count_tokens(separators.read_id_files(spark, str(tmp_path), 4, block), end_id=5).orderBy("shard", "ordinal").collect()
        by = {}
        for r in found:
            by.setdefault(r.shard.rsplit("/", 1)[1].removesuffix(".bin"), []).append((r.n_tokens, r.closed))
        assert by == {k: v for k, v in expected.items() if v}
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no whole number of ids"):
        separators.read_id_files(spark, str(tmp_path), 4).count()


def test_ids_keep_their_type(spark, tmp_path):
    docs = spark.createDataFrame([("y", "a b"), (None, None), ("x", "c")], "doc_id string, text string")
    token_files.write_token_files(docs, f"{tmp_path}/t", PATH)
    assert [r.doc_id for r in token_files.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()] == [None, "x", "y"]
    separators.write_flat_files(docs, f"{tmp_path}/f", PATH)
    blocks, names = separators.read_flat_files(spark, f"{tmp_path}/f")
    assert {(r.doc_id, r.n_tokens) for r in names.join(separators.count_tokens(blocks), ["shard", "ordinal"]).collect()} == {("y", 2), (None, 0), ("x", 1)}


def test_equal_rows_spread_over_shards(spark, tmp_path):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'the same text' AS text").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # this little would be one partition
    spark.conf.set(key, "false")
    try:
        token_files.write_token_files(docs, f"{tmp_path}/t", PATH)
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(f"{tmp_path}/t").select("shard").distinct().count() > 1
    found = token_files.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.start for r in found] == [k * found[0].n_tokens for k in range(4000)]
