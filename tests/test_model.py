"""Metrics by hand, preparation and fold hygiene."""

import pytest

from tracefp.plans import model


def predictions(spark):
    return spark.createDataFrame([("f1", "a", "a"), ("f1", "a", "b"), ("f1", "b", "b"), ("f1", "c", "b"), ("f2", "a", None)],
                                 "fold string, y string, yhat string")


def test_fold_metrics_by_hand(spark):
    row = model.fold_metrics(predictions(spark)).collect()
    assert len(row) == 1
    r = row[0]
    # classes a, b, c: precision 1, 1/3, 0; recall 1/2, 1, 0; f1 2/3, 1/2, 0
    assert r["accuracy"] == pytest.approx(0.5) and r["precision"] == pytest.approx((1 + 1 / 3) / 3)
    assert r["recall"] == pytest.approx(0.5) and r["f1"] == pytest.approx((2 / 3 + 0.5) / 3)
    assert model.fold_summary(model.fold_metrics(predictions(spark))).first()["std_f1"] == 0.0


def test_absent_class_has_no_score(spark):
    p = spark.createDataFrame([("t", "a", "a"), ("h", "b", "b")], "table string, y string, yhat string")
    rows = {r["class"]: r for r in model.class_f1_by_table(p, ["t", "h"]).collect()}
    assert rows["a"]["f1_t"] == 1.0 and rows["a"]["f1_h"] is None


def test_votes_tie_to_the_first_name(spark):
    v = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "b"), (2, "b"), (2, "a")], "cp int, yhat string")
    rows = {r["cp"]: (r["consensus"], r["votes"], r["n_models"]) for r in model.consensus_vote(v, ["cp"]).collect()}
    assert rows == {1: ("a", 1, 2), 2: ("b", 2, 3)}


def features(spark):
    rows = []
    for i in range(24):
        agent = "ab"[i % 2]
        rows.append((agent, f"trial-{i // 2:03d}", float(i % 2) + i * 0.001, 1.0, None if i % 5 == 0 else "same-origin",
                     "X-A" if agent == "a" else "", None if i % 7 == 0 else 2.0 * (i % 2)))
    return spark.createDataFrame(rows, "agent string, trial string, v double, constant double, sf_site_mode string, "
                                       "nonstandard_names string, w double")


def test_cross_validation_and_saved_model(spark, tmp_path):
    tables, labels = model.model_tables({"temporal": features(spark)})
    table = model.fold_of(tables["temporal"]).withColumn("fold", model.F.pmod(model.F.col("fold").cast("int"), model.F.lit(3)))
    out = model.cross_validate(table, labels, model.forest(5, 3))
    assert out.count() == 24 and out.where("y = yhat").count() == 24
    fitted = model.train_classifier(table, labels, model.forest(5, 3))
    model.save_model(fitted, str(tmp_path / "m"))
    loaded = model.load_model(str(tmp_path / "m"))
    assert model.model_labels(loaded) == ["a", "b"]
    # a live row with an unknown category and header name still scores
    live = model.prepare(spark.createDataFrame([("?", "t", 1.0, 1.0, "elsewhere", "X-New", None)], features(spark).schema))
    row = model.score_with_confidence(loaded, live).first()
    assert row["predicted"] in labels and sum(row["distribution"].values()) == pytest.approx(1.0, abs=1e-3)
    top = model.top2_classes(loaded, live).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["class"] == row["predicted"]


def test_preparation(spark):
    df = features(spark)
    assert "constant" not in model.drop_zero_variance(df).columns
    full = model.impute_median(df, ["w"])
    assert full.where("w IS NULL").count() == 0
    hot = model.multi_hot(df)
    assert "ns_hdr_X-A" in hot.columns and hot.agg(model.F.sum("ns_hdr_X-A")).first()[0] == 12
    codes = {r[0] for r in model.encode_categories(df, ["sf_site_mode"]).select("sf_site_mode").collect()}
    assert codes == {0, 1}
    with pytest.raises(ValueError):
        model.name_vocabulary(df, limit=0)


def test_stages_keep_all_names_and_exact_medians(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    names = ["common"] * 5 + [f"rare{k}" for k in range(7)]
    rows = [("a", f"t{k}", x, [n]) for k, (x, n) in enumerate(zip([1.0, 2.0, 10.0, 20.0, None, float("nan")] * 2, names))]
    df = spark.createDataFrame(rows, "agent string, trial string, x double, nonstandard_names array<string>")
    out = Pipeline(stages=model.feature_stages(df)).fit(df).transform(df)
    assert {r.x_full for r in out.where("x IS NULL OR isnan(x)").collect()} == {6.0}
    assert len(set(map(tuple, (r.n for r in out.select(vector_to_array("_names").alias("n")).collect())))) == 8


def test_unknown_fields_are_an_error(spark):
    import pytest

    from tracefp.plans.tls import field_stability

    df = spark.createDataFrame([("a", "t", "x")], "agent string, trial string, ja3 string")
    assert [r.field for r in field_stability(df, ["ja3"]).collect()] == ["ja3"]
    with pytest.raises(ValueError, match="absent"):
        field_stability(df, ["ja3", "absent"])


def test_fold_encoders_equal_stages_fitted_on_the_fold(spark):
    """Medians, codes and names of each fold from counts, against those of its training rows."""
    from pyspark.sql import functions as F

    df = model.prepare(spark.createDataFrame(
        [("ab"[i % 2], f"trial-{i:03d}", i % 4, float(i * i % 7) if i % 3 else None, float("nan") if i % 5 == 0 else 1.5 * i,
          "none" if i == 2 else "same-origin" if i % 3 else None, "X-A|X-B" if i == 5 else "X-C" if i % 2 else "") for i in range(24)],
        "agent string, trial string, fold int, n1 double, n2 double, sf_site_mode string, nonstandard_names string"))
    found = model.fold_encoders(df, [0, 1, 2, 3])
    for f, stages in found.items():
        seen = df.where(F.col("fold") != f)
        fitted = [s.fit(seen) if hasattr(s, "fit") else s for s in model.feature_stages(seen)[:3]]
        assert stages[0].labelsArray == fitted[0].labelsArray and stages[1].vocabulary == fitted[1].vocabulary
        keys = ["trial", "n1_full", "n2_full"]
        assert sorted(map(str, stages[2].transform(df).select(*keys).collect())) == sorted(map(str, fitted[2].transform(df).select(*keys).collect()))


def test_five_tables_share_their_folds(spark):
    df = spark.createDataFrame([("ab"[i % 2], f"t{i}", i % 3, float(i % 2) + i * 0.01, 1.0, float(i % 2)) for i in range(18)],
                               "agent string, trial string, fold int, x double, flat double, label double")
    out = model.cross_validate_tables({"one": df, "two": df.drop("flat")}, ["a", "b"], model.forest(5, 3)).collect()
    assert len(out) == 36 and {(r["table"], r["trial"]) for r in out} == {(t, f"t{i}") for t in ("one", "two") for i in range(18)}
    assert all(r["fold"] == int(r["trial"][1:]) % 3 for r in out)
    assert sum(r["y"] == r["yhat"] for r in out) >= 34


def test_a_fit_reads_written_rows_in_few_tasks(spark, monkeypatch):
    """Rows are encoded once into one table; the classifier gets them in as few partitions as their number asks for."""
    seen = []

    class Counted:
        def fit(self, df):
            seen.append((df.columns, df.rdd.getNumPartitions(), df.count()))
            return model.forest(3, 2).fit(df)

    df = model.prepare(spark.createDataFrame(
        [("ab"[i % 2], f"t{i}", i % 3, float(i % 2), 1.0 * i, None if i % 4 else "none", ["linux", "mac", "win"][i % 3], float(i % 2)) for i in range(30)],
        "agent string, trial string, fold int, x double, y double, sf_site_mode string, ua_os_mode string, label double")).repartition(6)
    monkeypatch.setattr(model, "FIT_ROWS", 7)
    # label lists of different lengths used to be filled with nulls, which cannot be written
    out = model.cross_validate_tables({"one": df}, ["a", "b"], Counted()).collect()
    assert len(out) == 30 and sum(r["y"] == r["yhat"] for r in out) >= 28
    assert [(c, n) for c, p, n in seen] == [(["label", "features"], 20)] * 3 and all(p <= 3 for _, p, _ in seen)
    models = model.train_tables({"one": df}, ["a", "b"], [0, 1, 2], model.forest(3, 2))
    assert set(models) == {("one", f) for f in range(3)}
    held = models["one", 0].transform(df.where("fold = 0"))
    assert held.count() == 10 and held.where("predicted IN ('a', 'b')").count() == 10
