"""Each stage against a plain version on its own input, and the whole run."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline as pipeline  # noqa: E402
import edge_cases  # noqa: E402

from placeloom.llm import common, quality  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    scratch = common.Scratch(spark, "t")
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = scratch.write(stage(spark, docs, SF))
        if k < 4:
            assert out.columns == columns, name
            assert out.select("doc_id").distinct().count() == out.count() <= docs.count()
            assert out.join(docs, "doc_id", "left_semi").count() == out.count()
        if k == 0:
            labels = common.table(spark, SF, "labels")
            lost = docs.join(out, "doc_id", "left_anti").join(labels, "doc_id")
            assert lost.where("quality = 1").count() <= 0.02 * labels.where("quality = 1").count()
            assert 0 < lost.where("quality = 0").count()
        if k == 1:  # of every group of equal texts the smallest id stays
            kept = {r.doc_id for r in out.collect()}
            first = {}
            for r in docs.orderBy("doc_id").collect():
                assert (r.doc_id in kept) <= (r.text not in first)
                first.setdefault(r.text, r.doc_id)
        if k == 2:
            kept = {r.doc_id for r in out.collect()}
            items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
            assert all(r.doc_id not in kept for r in docs.collect() if any(i in r.text for i in items))
        if k == 3:
            assert out.count() == docs.count()
        docs = out
    assert docs.where("length > 2048").count() == 0


def test_stages_take_odd_rows(spark):
    odd = edge_cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert quality.score_udf(quality.ByteConvNet(1)) is not None


def test_quality_stage_takes_odd_rows_and_rejects_nothing_unlearned(spark, tmp_path):
    odd = edge_cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    assert pipeline.quality_stage(spark, odd.limit(0), SF).count() == 0
    for k, rows in enumerate(([], [(i, 0, 0) for i in range(1, 11)], [(i, 1, 0) for i in range(1, 11)], [(1000 + i, i % 2, 0) for i in range(20)])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert pipeline.quality_stage(spark, odd, f"{tmp_path}/{k}").count() == odd.count()


def test_texts_under_one_id_are_judged_by_themselves(spark):
    a, b, c = (" ".join(edge_cases.words(seed, 120)) for seed in (1, 2, 3))
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, c), (3, c + " more"), (4, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert len(got) == 4 and {(1, a), (1, b), (None, a)} < set(got) and sum(i == 3 for i, _ in got) == 1


def test_near_duplicates_keep_columns_of_any_name(spark):
    docs = edge_cases.documents(spark).selectExpr("*", "7 AS text_hash", "'r' AS row", "'x' AS component", "1 AS `a.b`")
    out = pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=str) == [1, 10, 2, 5, 8, 9, None] and all((r.text_hash, r.row, r.component, r["a.b"]) == (7, "r", "x", 1) for r in rows)
    assert pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0
