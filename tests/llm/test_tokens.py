import zlib

import numpy as np
import pytest

from holdfast.llm import tokens
from tests.llm import cases

P = pytest.importorskip("public_tokenizers")
ODD = [
    "", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "\n", "don't we'll 's", "<|endoftext|> a", "a<|endoftext|>b c",
    "é,è. 12,3.4 a,. ,", "\x1c a b", "a\x85 b", "tab\tb c\td", "ab\r\ncd ef", "ﬁ ½ 日本語 の. x", "a. b,\nc. d\ne", "x" * 5000,
]


@pytest.fixture(scope="module")
def coder():
    return tokens.UnitEncoder(P.path("byte_bpe_50k.json"), 0)


def plain(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_units_encode_as_whole_texts(coder):
    texts = ODD + [t or "" for _, t, *_ in cases.rows()]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, coder.dtype).tolist() == plain(coder, text), text[:50]


def test_units_move_between_generations():
    small = tokens.UnitEncoder(P.path("byte_bpe_50k.json"), 0, most=20)
    for turn in range(12):
        texts = [cases.sentence(turn + k % 3, 30) + " common words stay" for k in range(4)] + ODD
        for text, ids in zip(texts, small.encode(texts)):
            assert np.frombuffer(ids, small.dtype).tolist() == plain(small, text)
        assert len(small.units) < 400 and len(small.older) < 400
    assert small.older and "common" in small.units


def test_read_back_takes_a_task_for_each_file(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word ', id) AS text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokens.write_records(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    read = tokens.read_records(manifest)
    files = read.selectExpr("spark_partition_id() AS task", "part").distinct().collect()
    assert len(files) == manifest.count() > 1
    assert len({r.task for r in files}) > 1
    last = read.orderBy("doc_id", ascending=False).head()
    assert last.start + last.n_tokens == sum(r.tokens for r in manifest.collect())


def test_round_trip(spark, tmp_path, coder):
    docs = cases.documents(spark, extra=True)
    manifest = tokens.write_records(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in tokens.read_records(manifest).collect()}
    start = 0
    for i, text, *_ in sorted(cases.rows(), key=lambda r: -1 if r[0] is None else r[0]):
        ids = plain(coder, text)
        r = got[i]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    path = manifest.orderBy("part").collect()[-1]["path"]
    doc_id, ids = tokens.read_at(path, 0)
    assert ids.tolist() == plain(coder, dict((r[0], r[1]) for r in cases.rows())[doc_id])


def test_empty_table(spark, tmp_path):
    docs = cases.documents(spark, empty=True)
    manifest = tokens.write_records(docs, f"file://{tmp_path}/t", P.path("byte_bpe_50k.json"))
    assert tokens.read_records(manifest).count() == 0


def test_damage_is_noticed(tmp_path):
    import io

    body = tokens.frame(tokens.pack(7, b"\x01\x00\x02\x00", False))
    assert tokens.unpack(tokens.read_frame(io.BytesIO(body)))[0] == 7
    for at in range(len(body)):
        bad = bytearray(body)
        bad[at] ^= 4
        with pytest.raises(tokens.DamagedFile):
            tokens.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(tokens.DamagedFile):
        tokens.read_frame(io.BytesIO(body[:-1]))
