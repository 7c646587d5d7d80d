"""The registered queries, over the smallest tables, against their SQL or a plain version."""

import collections
import glob
import os
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from sentilake.llm import language_id, queries, token_output

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(duck.sql(f"SELECT {quoted} FROM ({queries.SQL[name]})").fetchall())


def test_language_query_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    rows = docs.select("doc_id", "text").collect()
    assert len(model.dictionaries) > 1
    press = {k: zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in model.dictionaries.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        data = "".join(c for c in r.text.lower() if ord(c) > 127 or c not in language_id.NOISE.decode()).encode()
        sizes = sorted((sum(len(p.compress(data[i : i + model.block])) - language_id.FRAME for i in range(0, len(data), model.block)), k) for k, p in press.items())
        assert got[r.doc_id].lang_pred == sizes[0][1]
        assert got[r.doc_id].score == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[1][0])


def test_matrices_are_written_and_read_again(spark, tmp_path):
    rows = queries.QUERIES["op1_token_output"](spark, DATA)
    token_output.write_token_matrices(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    for r in back.collect():
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        assert not ids[r.n_tokens :].any() and all(positions[a] == 0 for a in r.cu_seqlens[:-1])
    found = {r.doc_id: len(r.ids) for r in token_output.read_documents(back).collect()}
    packed = collections.Counter()
    for r in queries.QUERIES["op4_packing"](spark, DATA).collect():
        packed[r.doc_id] += r.length
    assert found == packed
