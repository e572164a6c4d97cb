"""All operators and stages on one table with nulls in every column, empty, blank and very long texts, repeated rows and ids, ties, and
columns with clashing names; and on empty tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from depgrove.llm import jaccard_join, lm_scoring, packing, pieces, quality_classifier, quality_rules, substring_dedup, toxicity

C = F.col
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choices("mill stone grain flour sack cart road river wheel dust".split(), k=n))
    same = text(80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (5, same), (5, same), (5, text(70)), (6, same), (None, same), (None, None), (None, text(60)), (7, "one"), (8, "\x00\x01 é 😀")]
    rows += [(20 + i, text(60 + i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = F.lit(None).cast("string")
    names = ("lang", "source", "block", "range", "rep", "row", "path", "near", "held_out", "label", "score", "kept", "document", "row_of_join")
    return df.select("doc_id", "text", *[none.alias(n) for n in names], F.lit(None).cast("long").alias("n_chars"))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(20 + i, i % 2, i % 2) for i in range(30)] + [(5, 1, 0), (5, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (7, 3, 3), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_a_row_per_document(spark, cases, labels):
    import public_tokenizers

    want = ids(cases)
    path = public_tokenizers.path("piece_bpe_32k.model")
    trees, rules, network = quality_classifier.model(cases, labels), quality_rules.model(cases, labels), toxicity.model(cases, labels)
    scored = lm_scoring.score(cases, block_bytes=100_000)
    encoded = pieces.digests(cases, path)
    for df in (quality_classifier.score(cases, trees), quality_rules.judge(cases, rules), toxicity.score(cases, network), scored, substring_dedup.dedup(cases, block_bytes=100_000), encoded, jaccard_join.join(cases)):
        assert ids(df) == want
    assert encoded.where("NOT agrees").count() == 0
    same = lambda df, *columns: {tuple(r) for r in df.where("doc_id = 4").select(*columns).collect()}
    assert len(same(scored, "score", "n_tokens")) == 1 and same(scored, "n_tokens").pop()[0] == 60_001
    by = {}
    for r in jaccard_join.join(cases).collect():
        by.setdefault(r.doc_id, []).append((r.n_links, r.component_id, r.kept))
    assert sorted(by[5]) == [(0, 5, True), (3, 5, True), (3, 5, True)] and by[6] == [(3, 5, False)] and by[4] == [(1, 4, True)] * 2
    assert sorted(by[None], key=str) == [(0, None, True), (0, None, True), (3, 5, False)]
    assert all(by[d] == [(0, d, True)] for d in (1, 2, 3, 7))


def test_sampled_ids_have_one_row(spark, cases, labels):
    from depgrove.llm.common import bounded_sample, one_label, sampled_rows

    chosen = bounded_sample(one_label(labels, "quality"), 100, 5)
    rows = sampled_rows(cases, chosen, 1 << 16).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 31 and 4 not in {r.doc_id for r in rows}
    five = next(r for r in rows if r.doc_id == 5)
    assert five.label == 1 and five.text == min(r.text for r in cases.where("doc_id = 5").collect())


def test_packing_of_all_cases(spark, cases):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(cases, path, shard_bytes=50_000).collect()
    assert {r.doc_id for r in found} == set(ids(cases))
    assert sum(r.length for r in found if r.doc_id == 4) == 2 * next(r.doc_tokens for r in found if r.doc_id == 4)
    again = packing.pack(cases.repartition(3), path, shard_bytes=1 << 30).collect()
    whole = packing.pack(cases.repartition(5), path, shard_bytes=1 << 30).collect()
    plain = lambda rows: collections.Counter((r.doc_id, r.doc_tokens, r.start == 0) for r in rows if r.start == 0)
    assert plain(again) == plain(whole) == plain(found)


def test_filters_keep_columns(spark, cases, labels):
    for df in (quality_classifier.keep_good(cases, labels), quality_rules.keep_clean(cases, labels), jaccard_join.keep_one(cases), substring_dedup.remove(cases)):
        assert df.columns == cases.columns
        df.collect()
    one = jaccard_join.keep_one(cases).collect()
    assert collections.Counter(r.doc_id for r in one) == collections.Counter({**{d: 1 for d in ids(cases) if d not in (None, 6)}, None: 2, 5: 2})


def test_empty_tables(spark, cases, labels, tmp_path):
    import public_tokenizers

    import corpus_pipeline

    none = cases.limit(0)
    for rows, known in ((none, labels), (none, labels.limit(0)), (cases, labels.limit(0))):
        n = rows.count()
        assert quality_classifier.score(rows, quality_classifier.model(rows, known)).count() == n
        assert quality_rules.judge(rows, quality_rules.model(rows, known)).count() == n
        assert toxicity.score(rows, toxicity.model(rows, known)).count() == n
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0 and jaccard_join.keep_one(none).count() == 0 and substring_dedup.remove(none).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_all_cases(spark, cases, labels, tmp_path):
    import corpus_pipeline

    cases.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == cases.columns
    kept = collections.Counter(r.doc_id for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == kept
