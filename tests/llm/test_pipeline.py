"""The pipeline against plain versions of its stages, and its contract."""
import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from wirework.llm import mixing, ngram_join, quality
from wirework.llm.common import materialize, table

from conftest import SMALL
from llm.test_brute_force import plain_dedup


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing", "BPE"]


def test_each_stage(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        kept[name] = (docs, docs := spark.read.parquet(str(tmp_path / str(k))))
    for name, (_, after) in list(kept.items())[:-1]:
        assert set(after.columns) == {"doc_id", "text", "lang", "source", "n_chars"}, name

    before, after = kept["quality rules"]
    good = quality.quality_report(before, table(spark, SMALL, "labels")).filter("kept")
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())

    before, after = kept["n-gram Jaccard join"]
    first = {r["component_id"] for r in ngram_join.join_report(before).collect()}
    assert sorted(first) == sorted(r[0] for r in after.select("doc_id").collect())

    before, after = kept["suffix-array dedup"]
    want = plain_dedup([(r["doc_id"], r["text"]) for r in before.collect()])
    left = {w[0]: w[4].decode("utf-8", "ignore") for w in want}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t for i, t in left.items() if t}

    before, after = kept["mixing"]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixing_report(before).collect() if r["size"]}
    got = [r[0] for r in after.select("doc_id").collect()]
    assert sorted(got) == sorted(i for i, n in taken.items() for _ in range(n))

    before, after = kept["BPE"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names}


def test_tokens_keep_the_training_order(spark, tmp_path):
    """On files of several lengths, which a scan does not read in the order written."""
    rows = [(i, f"text {i} " + "word " * (i * 37 % 900), "en", "abc"[i % 3], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sequences = []
    for k, schedules in enumerate([mixing.SCHEDULES, mixing.SCHEDULES[1:] + mixing.SCHEDULES[:1]]):
        mixed = mixing.curriculum(docs, schedules=schedules)
        want = [r["doc_id"] for r in mixed.collect()]
        # uneven ranges: the last files are the longest
        cuts = [0, 3, 20, 90, 91, len(want)]
        numbered = spark.createDataFrame([(i, n, sum(n >= c for c in cuts[1:-1])) for n, i in enumerate(want)],
                                         "doc_id bigint, n int, file int")
        byfile = (numbered.join(docs, "doc_id").rdd.map(lambda r: (r["file"], r)).partitionBy(5, int).values()
                  .mapPartitions(lambda x: sorted(x, key=lambda r: r["n"])))
        out = str(tmp_path / str(k))
        spark.createDataFrame(byfile, numbered.join(docs, "doc_id").schema).select(*docs.columns).write.parquet(out)
        tokens = corpus_pipeline.tokens(spark, spark.read.parquet(out), SMALL)
        got = [r["doc_id"] for r in tokens.orderBy("part", "row").collect()]
        assert got == want
        assert tokens.select("part").distinct().count() == 5
        sequences.append(got)
    assert sequences[0] != sequences[1]


def test_run_keeps_the_training_order(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, label: kept.append(materialize(df, label)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens = corpus_pipeline.run(spark, SMALL)
        want = [r["doc_id"] for r in mixing.curriculum(kept[2]).select("doc_id").collect()]
        assert [r["doc_id"] for r in tokens.orderBy("part", "row").collect()] == want
        assert tokens.select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
