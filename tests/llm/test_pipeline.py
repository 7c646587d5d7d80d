"""The pipeline, each stage on what the one before kept, against plain versions and the operators' SQL."""

import collections
import random

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from sentilake.llm import language_id, queries
from tests.llm.test_operators import DOCS, plain_components, plain_simhash, true_ids


def documents():
    rng = random.Random(1)
    stems = {"en": ["the", "of", "ing", "tion", "and"], "de": ["der", "und", "sch", "ein", "ung"]}
    text = lambda n, lang="en": " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(rng.choice([60, 120]), lang), lang, rng.choice(["a", "b", None]), 0) for i in range(180) for lang in [rng.choice(["en", "de"])]]
    rows += [(200 + i, rows[3][1], "en", "a", 0) for i in range(5)] + [(210, text(70) + " ###" * 60, "en", "a", 0), (211, text(6000), "en", "b", 0)]
    rows += [(300, None, "en", "a", 0), (301, "", None, None, None), (None, text(80), None, None, None), (302, "x y", "en", "a", 0), (4, rows[4][1], "en", "b", 0), (303, "12 !! 34", "en", "a", 0)]
    return rows


def kept(df):
    return collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_each_stage_equals_a_plain_version(spark, tmp_path):
    rows, duck = documents(), duckdb.connect()
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("near_fp", F.lit(1)).withColumn("n_words", F.lit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, seen, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, seen = seen, spark.read.parquet(str(tmp_path / name))
        out[name] = seen
        duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        if name != "pack":
            assert seen.columns == docs.columns, name
        if name == "language_id":
            model = language_id.learn(before)
            want = collections.Counter((i, t, s) for i, t, _, s, _ in rows for lang, score in [model.predict(t)] if lang != "und" and score >= model.margin)
            assert kept(seen) == want and {r.lang for r in seen.collect()} == {"en", "de"}
        if name == "quality_rules":
            duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/language_id/*.parquet'")
            ids = collections.Counter(r[0] for r in duck.sql(f"SELECT doc_id FROM ({queries.SQL['op9_quality_rules']}) WHERE kept").fetchall())
            assert collections.Counter(r.doc_id for r in seen.collect()) == ids and 210 not in ids
        if name == "simhash_near_dedup":
            all_ = [(r.doc_id, r.text) for r in before.collect()]
            prints = [plain_simhash(t) for _, t in all_]
            root = plain_components(len(all_), [(i, j) for i in range(len(all_)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
            least = collections.defaultdict(list)
            for (i, _), r in zip(all_, root):
                least[r] += [i] if i is not None else []
            assert collections.Counter(r.doc_id for r in seen.collect()) == collections.Counter(min(v, default=None) for v in (least[r] for r in set(root)))
        if name == "mix_sources":
            duck.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/simhash_near_dedup/*.parquet'")
            want = {r[0]: r[1] for r in duck.sql(f"SELECT doc_id, taken // size FROM ({queries.SQL['op10_mixing']}) WHERE taken > 0").fetchall()}
            assert collections.Counter(r.doc_id for r in seen.collect()) == want
    packed = collections.Counter()
    for r in out["pack"].collect():
        packed[r.doc_id] += r.length
    want = collections.Counter()
    for r in out["mix_sources"].collect():
        want[r.doc_id] += len(true_ids(r.text))
    assert packed == want
    assert sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).select("length").collect()) == sum(packed.values())


def test_an_empty_table_and_one_long_text(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(720_000))  # 5 MB
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)), "en", "s", 0) for i in range(60)] + [(99, long, "en", "s", 0)]
    docs = spark.createDataFrame(rows + [(500 + i, "der und sch " * 30, "de", "s", 0) for i in range(3)], DOCS)
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, str(tmp_path))
    assert 99 in {r.doc_id for r in docs.select("doc_id").collect()}
