import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnworks.llm import sstable
from tarnworks.llm.common import Work
from tarnworks.llm.lengths import length_histogram, suffix_sums
from tarnworks.llm.tokens import Encoder, vocabulary_path

from . import docs


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts(plain):
    rng, own = random.Random(3), Encoder(vocabulary_path(), most_pieces=50)
    parts = [" ", "\n", "a", "B", "é", " the", "'s", "1", "\t", " ", "\0", "!", "\x1c", "　", "<|endoftext|>", "  ", "\r\n", "\u0085", "日本", "​", " don't.", " x,y", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [r[1] for r in docs.ROWS]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain(text), repr(text)


def test_special_strings(plain):
    text = "a <|endoftext|> b<|endoftext|>\n<|endoftext|>c  <|endoftext|>"
    own, letters = (np.frombuffer(Encoder(vocabulary_path(), special_as_text=flag).encode(text), "<u4").tolist() for flag in (False, True))
    assert own == plain(text) and own.count(50256) == 4 and own[:4] == [64, 220, 50256, 275]
    assert 50256 not in letters


def test_one_identifier_fills_several_shards(spark, plain):
    rows = [(None if k % 2 else 7, f"text number {k % 40}" if k < 400 else "the same") for k in range(800)] + [(k, "x") for k in range(20)]
    work = Work(spark, "test")
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), work, vocabulary_path(), shards=6)
    assert manifest.count() == 6 and manifest.agg({"n_docs": "max"}).first()[0] < 350
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == sorted((r.doc_id is None for r in got), reverse=True)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    want = Counter((k, zlib.crc32(np.array([*plain(t), 0], "<u4").tobytes())) for k, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    found = [ids for path in sstable.shards_of(manifest, 7) for ids in sstable.ShardReader(path).get(7)]
    assert len(found) == sum(k == 7 for k, _ in rows)


def test_round_trip(spark, plain):
    table = docs.docs(spark).where("doc_id is not null")
    work = Work(spark, "test")
    manifest = sstable.write_shards(table, work, vocabulary_path(), shards=3)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text, *_) in zip(got, sorted((r for r in docs.ROWS if r[0] is not None), key=lambda r: r[0]), strict=True):
        ids = np.array([*plain(text), 0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_lookup(tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.randrange(-(10**6), 10**6), rng.randrange(0, 400)) for _ in range(5000)) + [(2 * 10**6, 5)] * 3
    path = tmp_path / "x.sst"
    with path.open("wb") as sink:
        writer = sstable.ShardWriter(sink)
        for doc_id, n in rows:
            writer.add(sstable.key_of(doc_id), np.arange(n, dtype="<u4").tobytes() + np.array([70_000], "<u4").tobytes())
        writer.close()
    reader, many = sstable.ShardReader(f"file://{path}"), Counter(k for k, _ in rows)
    assert len(reader.blocks) > 3 and reader.n_docs == len(rows)
    assert [k for k, _ in reader] == [k for k, _ in rows]
    for doc_id, _ in rows[::50] + rows[-3:]:
        assert len(reader.get(doc_id)) == many[doc_id]
    assert not any(reader.get(10**7 + k) for k in range(500))
    data = bytearray(path.read_bytes())
    data[10] ^= 255
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.ShardReader(f"file://{path}"))


def test_null_identifiers_and_empty_tables(spark):
    assert {r.doc_id for r in sstable.token_output(docs.docs(spark), vocabulary_path()).collect()} == {r[0] for r in docs.ROWS}
    assert sstable.token_output(docs.empty(spark), vocabulary_path()).count() == 0
    assert suffix_sums(length_histogram(docs.empty(spark), vocabulary_path())).count() == 0


def test_suffix_sums(spark, plain):
    lengths = [len(plain(r[1])) for r in docs.ROWS]
    got = {r.n_tokens: r for r in suffix_sums(length_histogram(docs.docs(spark), vocabulary_path())).collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for limit, row in got.items():
        assert row.longer_docs == sum(n > limit for n in lengths)
        assert row.longer_tokens == sum(n for n in lengths if n > limit)
        assert row.truncated_tokens == sum(min(n, limit) for n in lengths)
        assert row.total_tokens == sum(lengths)
        assert row.quantile == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
