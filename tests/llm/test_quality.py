import numpy as np
from pyspark.sql import functions as F

from weirflow.llm.quality import estimate_prior, features, fit, fit_pu, keep_good, score_report


def test_features():
    assert features(None).sum() == features("").sum() == 1
    assert np.isfinite(features("a" * 300_000)).all() and np.isfinite(features(" ")).all()
    assert features("ABC!! DEF!!")[1] == 1


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    make = lambda n, shift: np.column_stack([np.ones(n), rng.normal(shift, 1, n)])
    positive, unlabelled = make(4000, 3), np.concatenate([make(5600, 3), make(2400, -3)])
    unlabelled = unlabelled[rng.permutation(len(unlabelled))]
    assert abs(estimate_prior(positive, unlabelled) - 0.7) < 0.05
    model = fit_pu(positive, unlabelled)
    assert (make(1000, 3) @ model.weights > 0).mean() > 0.97 and (make(1000, -3) @ model.weights < 0).mean() > 0.97


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = score_report(docs, labels)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    bad, good = held[held.quality == 0], held[held.quality == 1]
    auc = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()  # ranks of 2000 rows
    assert auc > 0.97 and (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8
    assert got.where("score < 0 or score > 1").count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(fit(docs, labels).weights, fit(docs, flipped).weights)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 0.1), (2, "", "y", 0.2), (None, "a b", "z", 0.3), (2, "q" * 200_000, "y", 0.2)], "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    rows = score_report(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert keep_good(docs, labels).columns == docs.columns
    assert score_report(docs.limit(0), labels.limit(0)).count() == 0
    assert [r.score for r in score_report(docs, labels.limit(0)).collect()] == [0.5] * 4


def test_few_ids_with_many_rows(spark):
    """What is fitted doesn't hang on the order of rows, even if there are many more rows than may be taken."""
    rows = [(i % 40, f"{'good plain words here' if i % 40 < 20 else 'zz## 11 !! qq'} {i % 7}") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fits = [fit(d, labels, 150, 300).weights for d in (docs.repartition(2), docs.orderBy(F.desc("text")).repartition(5))]
    assert abs(fits[0] - fits[1]).max() < 1e-9 and abs(fits[0]).max() > 0
    assert fit(docs, labels, 3, 3).weights.shape == fits[0].shape
