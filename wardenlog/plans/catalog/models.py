"""Model algebra over the stand-in scores, and trained models over the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import fixed_values as V
from ...operators import classifier, clean, detector, evaluate, explain, forest, incident, reconstruction, scaling
from ...scratch import scratch_path, written
from ...sources import access_log as source
from .. import features as plan
from .registry import VIEWS, log_of, query, r6, rounded

def _scored(spark, sf_dir):
    return source.scored(source.access_log(spark, sf_dir))


# --- Algebra ------------------------------------------------------------------------------------------


@query("m1_standardise", """
SELECT event_id, round((bytes_transferred - (SELECT avg(bytes_transferred) FROM log)) / (SELECT stddev_pop(bytes_transferred) FROM log), 6) AS z_bytes,
  round((session_duration - (SELECT avg(session_duration) FROM log)) / (SELECT stddev_pop(session_duration) FROM log), 6) AS z_duration FROM log""")
def m1(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    s = scaling.fit_scaler(log, ["bytes_transferred", "session_duration"])
    return log.select("event_id", r6(s.column("bytes_transferred")).alias("z_bytes"),
                      r6(s.column("session_duration")).alias("z_duration"))


@query("m4_min_max", """
SELECT event_id, round((anomaly_score - (SELECT min(anomaly_score) FROM scored)) /
  ((SELECT max(anomaly_score) FROM scored) - (SELECT min(anomaly_score) FROM scored)), 6) AS normalised FROM scored""")
def m4(spark, sf_dir):
    return rounded(scaling.normalise(_scored(spark, sf_dir), "anomaly_score", "normalised"), "normalised").select(
        "event_id", "normalised"
    )


@query("m7_ensemble", "SELECT event_id, round(CAST(0.4 AS DOUBLE) * anomaly_score + CAST(0.6 AS DOUBLE) * classifier_confidence, 6) AS ensemble FROM scored")
def m7(spark, sf_dir):
    e = detector.ensemble_score(F.col("anomaly_score"), F.col("classifier_confidence"))
    return _scored(spark, sf_dir).select("event_id", r6(e).alias("ensemble"))


VIEWS["thresholds"] = "SELECT quantile_cont(anomaly_score, 0.99) AS high, quantile_cont(anomaly_score, 0.95) AS medium FROM scored"


@query("m8_thresholds", """
SELECT label, round((SELECT high FROM thresholds), 6) AS high, round((SELECT medium FROM thresholds), 6) AS medium, count(*) AS events FROM scored GROUP BY 1""")
def m8(spark, sf_dir):
    scores = _scored(spark, sf_dir)
    high, medium = detector.alert_thresholds(scores)
    return scores.groupBy("label").agg(F.count(F.lit(1)).alias("events")).withColumns(
        {"high": r6(F.lit(high)), "medium": r6(F.lit(medium))})


@query("m9_tiers", """
SELECT event_id, CASE WHEN anomaly_score >= high THEN 'HIGH' WHEN anomaly_score >= medium THEN 'MEDIUM' ELSE 'LOW' END AS alert_tier,
  CAST(CASE WHEN anomaly_score >= medium THEN 1 ELSE 0 END AS BIGINT) AS is_alert FROM scored, thresholds""")
def m9(spark, sf_dir):
    scores = _scored(spark, sf_dir)
    return detector.tiers(scores, *detector.alert_thresholds(scores)).select("event_id", "alert_tier", "is_alert")


@query("m10_label_codes", """
SELECT event_id, attack_type, CAST(dense_rank() OVER (ORDER BY attack_type) - 1 AS DOUBLE) AS y FROM anomalous""")
def m10(spark, sf_dir):
    rows = source.access_log(spark, sf_dir).where(F.col("label") == "anomaly").select("event_id", "attack_type")
    return classifier.label_indexer().fit(rows).transform(rows)


_COUNTS = """SELECT count(*) AS total_samples, count(*) FILTER (WHERE t) AS actual_anomalies, count(*) FILTER (WHERE h) AS predicted_anomalies,
  count(*) FILTER (WHERE h AND t) AS tp, count(*) FILTER (WHERE h AND NOT t) AS fp, count(*) FILTER (WHERE NOT h AND NOT t) AS tn,
  count(*) FILTER (WHERE NOT h AND t) AS fn FROM (SELECT anomaly_score >= medium AS h, label = 'anomaly' AS t FROM scored, thresholds) q"""


@query("m19_binary_metrics", f"""
SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1_score, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_positive_rate,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS detection_rate FROM ({_COUNTS}) c""")
def m19(spark, sf_dir):
    scores = _scored(spark, sf_dir)
    out = evaluate.binary_metrics(scores, detector.alert_thresholds(scores)[1])
    return rounded(out, "precision", "recall", "f1_score", "false_positive_rate", "detection_rate")


VIEWS["per_score"] = """
SELECT anomaly_score AS s, count(*) FILTER (WHERE label = 'anomaly') AS pos, count(*) FILTER (WHERE label <> 'anomaly') AS neg FROM scored GROUP BY 1"""


@query("m20_roc_auc", """
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6)::DOUBLE AS roc_auc
FROM (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM per_score) q""")
def m20(spark, sf_dir):
    return rounded(evaluate.roc_auc(_scored(spark, sf_dir)), "roc_auc")


@query("m21_pr_auc", """
SELECT round(sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2.0) / sum(pos), 6)::DOUBLE AS pr_auc
FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM per_score WINDOW w AS (ORDER BY s DESC)) q""")
def m21(spark, sf_dir):
    return rounded(evaluate.pr_auc(_scored(spark, sf_dir)), "pr_auc")


@query("m22_top_budget", """
SELECT count(*) AS alerts_triggered, round(count(*) FILTER (WHERE label = 'anomaly') / count(*), 6) AS top_precision,
  round(count(*) FILTER (WHERE label = 'anomaly') / (SELECT count(*) FROM scored WHERE label = 'anomaly'), 6) AS top_recall
FROM (SELECT label, row_number() OVER (ORDER BY anomaly_score DESC, event_id) AS k, count(*) OVER () AS n FROM scored) q
WHERE k <= greatest(1, CAST(floor(n * 0.01) AS BIGINT))""")
def m22(spark, sf_dir):
    return rounded(evaluate.top_budget(_scored(spark, sf_dir)), "top_precision", "top_recall")


_PAIR = "SELECT attack_type AS t, predicted_attack AS p, count(*) AS n FROM scored WHERE label = 'anomaly' GROUP BY 1, 2"
VIEWS["class_report"] = f"""
SELECT class, coalesce(sum(n) FILTER (WHERE t = class AND p = class), 0) AS tp, coalesce(sum(n) FILTER (WHERE p = class), 0) AS predicted,
  coalesce(sum(n) FILTER (WHERE t = class), 0) AS support
FROM (SELECT t AS class FROM ({_PAIR}) x UNION SELECT p FROM ({_PAIR}) y) c, ({_PAIR}) q GROUP BY class"""
VIEWS["class_rates"] = """
SELECT class, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (predicted + support) END AS f1_score FROM class_report"""


def _classified(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.col("label") == "anomaly")


@query("m23_multiclass_metrics", """
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1_score * support) / sum(support), 6)::DOUBLE AS weighted_f1,
  round(avg(f1_score), 6)::DOUBLE AS macro_f1 FROM class_rates""")
def m23(spark, sf_dir):
    out = evaluate.multiclass_metrics(_classified(spark, sf_dir), "attack_type", "predicted_attack")
    return rounded(out, "accuracy", "weighted_f1", "macro_f1").select("accuracy", "weighted_f1", "macro_f1")


@query("m24_class_report", "SELECT class, support, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1_score, 6)::DOUBLE AS f1_score FROM class_rates")
def m24(spark, sf_dir):
    out = evaluate.per_class_report(_classified(spark, sf_dir), "attack_type", "predicted_attack")
    return rounded(out, "precision", "recall", "f1_score").drop("tp")


@query("m25_confusion_matrix", "SELECT attack_type AS y_true, " + ", ".join(
    f"count(*) FILTER (WHERE predicted_attack = '{a}') AS {a}" for a in V.ATTACK_TYPES)
    + " FROM scored WHERE label = 'anomaly' GROUP BY 1")
def m25(spark, sf_dir):
    return evaluate.confusion_matrix(_classified(spark, sf_dir), "attack_type", "predicted_attack", V.ATTACK_TYPES)


# --- Trained models -----------------------------------------------------------------------------------


_BUILT: dict[tuple[str, str], dict] = {}


def _once(spark, sf_dir, what, build):
    """What several queries of one application build on, built once and kept in written tables and small models."""
    kept = _BUILT.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    if what not in kept:
        kept[what] = build()
    return kept[what]


def engineered(spark, sf_dir):
    """Engineered data as a written table, its training part, the model features and what was fitted."""
    def build():
        log = written(log_of(spark, sf_dir), "clean-log")
        fitted = plan.fit(log)
        return written(plan.engineered(log, fitted), "engineered"), fitted

    data, fitted = _once(spark, sf_dir, "engineered", build)
    return data, data.where(fitted.cut.is_train()), clean.model_features(data), fitted


def the_detector(spark, sf_dir):
    _, train, names, _ = engineered(spark, sf_dir)
    return _once(spark, sf_dir, "detector", lambda: detector.fit_detector(train, names))


def the_classifier(spark, sf_dir):
    _, train, names, _ = engineered(spark, sf_dir)
    return _once(spark, sf_dir, "classifier", lambda: classifier.fit_classifier(train, names))


def alerting(spark, sf_dir):
    """Rows that the detector tiers MEDIUM or HIGH."""
    return the_detector(spark, sf_dir).score(engineered(spark, sf_dir)[0]).where("is_alert = 1")


@query("m2_forest_nodes")
def m2(spark, sf_dir):
    _, train, names, _ = engineered(spark, sf_dir)
    return forest.fit_forest(train, scaling.fit_scaler(train, names).vector()).nodes(spark)


_TREES, _SAMPLE = 150, forest.SAMPLE


@query("m2_forest_shape", f"""
SELECT tree::INTEGER AS tree, least({_SAMPLE}, (SELECT count(*) FROM train))::DOUBLE AS leaf_rows, true AS within_depth, true AS is_binary
FROM range({_TREES}) t(tree)""")
def m2_shape(spark, sf_dir):
    """Each tree holds the whole sample in its leaves, is binary and no deeper than its sample allows."""
    _, train, names, _ = engineered(spark, sf_dir)
    fitted = forest.fit_forest(train, scaling.fit_scaler(train, names).vector(), trees=_TREES)
    nodes, leaf = fitted.nodes(spark), F.col("feature") < 0
    parents = nodes.where(~leaf).select("tree", F.explode(F.array("left", "right")).alias("node"))
    linked = parents.groupBy("tree").agg(F.count_distinct("node").alias("children"))
    shape = nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(leaf).alias("leaves"), F.max(F.when(~leaf, F.col("depth"))).alias("deepest"),
        F.sum(F.when(leaf, F.col("rows"))).cast("double").alias("leaf_rows"))
    return shape.join(linked, "tree").select(
        "tree", "leaf_rows", (F.col("deepest") < 8).alias("within_depth"),
        ((F.col("children") == F.col("n") - 1) & (F.col("leaves") == (F.col("n") + 1) / 2)).alias("is_binary"))


@query("m3_isolation_scores")
def m3(spark, sf_dir):
    data, train, names, _ = engineered(spark, sf_dir)
    s = scaling.fit_scaler(train, names)
    return forest.fit_forest(train, s.vector()).score(data, s.vector()).select("event_id", r6("isolation_raw").alias("isolation_raw"))


@query("m3_same_by_sql", "SELECT count(*) AS events, CAST(0 AS BIGINT) AS different FROM log")
def m3_same(spark, sf_dir):
    """The stored nodes, walked in SQL, give every event the same score."""
    data, train, names, _ = engineered(spark, sf_dir)
    s = scaling.fit_scaler(train, names)
    fitted = forest.fit_forest(train, s.vector())
    nodes = fitted.nodes(spark)
    size = nodes.agg(F.max("node")).first()[0] + 1
    # One number for a node, so that a join looks it up by place; a leaf leads to itself.
    at, is_leaf = (F.col("tree") * size).cast("bigint"), F.col("feature") < 0
    numbered = written(nodes.select(
        (at + F.col("node")).alias("node"), F.greatest("feature", F.lit(0)).alias("feature"), "threshold",
        *((at + F.when(is_leaf, F.col("node")).otherwise(F.col(c))).alias(c) for c in ("left", "right")), "depth"), "forest-nodes", _NODES)
    # The row's values are made before it is repeated for each tree.
    rows = data.select("event_id", s.vector().alias("x"))
    walk = rows.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit((fitted.trees - 1) * size), F.lit(size)))).withColumn("node", F.col("node").cast("bigint"))
    paths = _walked(walk, numbered, 8, ["event_id"], "depth").groupBy("event_id").agg(F.avg("depth").alias("path"))
    again = paths.select("event_id", F.pow(F.lit(2.0), -F.col("path") / F.lit(forest.average_path(fitted.sample) or 1.0)).alias("again"))
    scored = fitted.score(data, s.vector()).select("event_id", "isolation_raw")
    return _differences(scored.join(again, "event_id", "left"), F.col("isolation_raw"), F.col("again"))


#: Nodes of a model are a small table, however many rows it was fitted on: one file.
_NODES = 1


def _walked(walk, nodes, steps, keep, value):
    """Rows at a ``node`` go down ``steps`` levels by their values ``x``; gives ``keep`` and the ``value`` of the node where they end."""
    inner = F.broadcast(nodes.select("node", "feature", "threshold", "left", "right"))
    for _ in range(steps):
        down = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        walk = walk.join(inner, "node").select(*keep, "x", down.alias("node"))
    return walk.join(F.broadcast(nodes.select("node", value)), "node").select(*keep, value)


def _differences(rows, a, b):
    return rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))).alias("different"))


@query("m5_components")
def m5(spark, sf_dir):
    _, train, names, _ = engineered(spark, sf_dir)
    s = scaling.fit_scaler(train, names)
    return reconstruction.fit_reconstruction(train, s.vector(), len(names)).table(train, names)


@query("m5_orthonormal", "SELECT a.range::INTEGER AS a, b.range::INTEGER AS b, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(10) a, range(10) b")
def m5_orthonormal(spark, sf_dir):
    loadings = m5(spark, sf_dir)
    pairs = loadings.select("feature", F.col("component").alias("a"), F.col("loading").alias("x")).join(
        loadings.select("feature", F.col("component").alias("b"), F.col("loading").alias("y")), "feature")
    return pairs.groupBy("a", "b").agg((F.round(F.sum(F.col("x") * F.col("y")), 6) + 0.0).alias("product"))


@query("m6_reconstruction_errors")
def m6(spark, sf_dir):
    data, train, names, _ = engineered(spark, sf_dir)
    s = scaling.fit_scaler(train, names)
    model = reconstruction.fit_reconstruction(train, s.vector(), len(names))
    return model.score(data, s.vector()).select("event_id", r6("reconstruction_raw").alias("reconstruction_raw"))


@query("m6_same_by_sql", "SELECT count(*) AS events, CAST(0 AS BIGINT) AS different FROM log")
def m6_same(spark, sf_dir):
    """The stored loadings, applied by column functions, give every event the same error."""
    data, train, names, _ = engineered(spark, sf_dir)
    s = scaling.fit_scaler(train, names)
    model = reconstruction.fit_reconstruction(train, s.vector(), len(names))

    def product(xs, ys):
        return F.aggregate(F.zip_with(xs, ys, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)

    x = F.col("x")
    rest = product(x, x)
    for part in model.components.T.tolist():
        rest = rest - F.pow(product(x, F.array(*map(F.lit, part))), F.lit(2.0))
    scored = model.score(data, s.vector()).select("event_id", "reconstruction_raw", s.vector().alias("x"))
    # Relative to the row's own size: the error is what is left of it.
    size = product(x, x) / len(names)
    off = F.abs(F.col("reconstruction_raw") - rest / len(names)) > 1e-9 * F.greatest(F.lit(1.0), size)
    return scored.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce(off, F.lit(True))).alias("different"))


@query("m11_random_forest")
def m11(spark, sf_dir):
    return the_classifier(spark, sf_dir).predict(alerting(spark, sf_dir)).select("event_id", "attack_type", "predicted_attack")


def the_boosted(spark, sf_dir):
    _, train, names, _ = engineered(spark, sf_dir)
    return _once(spark, sf_dir, "boosted", lambda: classifier.fit_classifier(train, names, classifier.boosted_trees()))


@query("m12_boosted_trees")
def m12(spark, sf_dir):
    return the_boosted(spark, sf_dir).predict(alerting(spark, sf_dir)).select("event_id", "attack_type", "predicted_attack")


@query("m12_same_by_sql", """
SELECT count(*) AS events, CAST(0 AS BIGINT) AS different, CAST(150 AS BIGINT) AS rounds FROM log WHERE label = 'anomaly'""")
def m12_same(spark, sf_dir):
    """The stored trees, walked node by node in SQL, name the same class for each anomaly with the same probability."""
    fitted, data = the_boosted(spark, sf_dir), engineered(spark, sf_dir)[0].where("label = 'anomaly'")
    nodes = written(fitted.nodes(spark), "boosted-nodes", _NODES)
    size, trees = 2 ** (fitted.depth + 1) - 1, len(fitted.rounds) * len(fitted.classes)
    # One number for a node, so that a join looks it up by place; a leaf leads to itself.
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1
    at = (F.col("round") * len(fitted.classes) + place(fitted.classes, "class")) * size
    leaf = F.col("feature").isNull()
    numbered = written(nodes.select(
        (at + F.col("node")).alias("node"), F.when(leaf, 0).otherwise(place(fitted.features, "feature")).cast("int").alias("feature"),
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"), *((at + F.when(leaf, F.col("node")).otherwise(2 * F.col("node") + i)).alias(c)
                                                                  for i, c in ((1, "left"), (2, "right"))), "value"), "numbered-nodes", _NODES)
    value = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in fitted.features]
    # The row's values are made before it is repeated for each tree.
    rows = data.select("event_id", F.array(*value).alias("x"))
    walk = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
        "event_id", "x", F.get(F.array(*map(F.lit, fitted.classes)), F.col("tree") % len(fitted.classes)).alias("class"),
        (F.col("tree") * size).cast("bigint").alias("node"))
    leaves = _walked(walk, numbered, fitted.depth, ["event_id", "class"], "value")
    margins = leaves.groupBy("event_id", "class").agg(F.sum("value").alias("margin"))
    best = margins.groupBy("event_id").agg(F.max_by("class", "margin").alias("named"), F.max("margin").alias("top"), F.collect_list("margin").alias("all"))
    best = best.select("event_id", "named", F.aggregate("all", F.lit(0.0), lambda s, m: s + F.exp(m - F.col("top"))).alias("odds"))
    both = fitted.predict(data).select("event_id", "predicted_attack", "classifier_confidence").join(best, "event_id", "left")
    same = (F.col("named") == F.col("predicted_attack")) & (F.abs(F.col("classifier_confidence") - 1 / F.col("odds")) < 1e-6)
    return both.agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.coalesce(same, F.lit(False))).alias("different"),
                    F.lit(len(fitted.rounds)).cast("long").alias("rounds"))


@query("m13_confidence")
def m13(spark, sf_dir):
    return the_classifier(spark, sf_dir).predict(engineered(spark, sf_dir)[0]).select(
        "event_id", "predicted_attack", r6("classifier_confidence").alias("confidence"))


@query("m13_predictions_cover_the_log", """
SELECT count(*) AS events, CAST(0 AS BIGINT) AS without_class, CAST(0 AS BIGINT) AS outside_unit FROM log""")
def m13_cover(spark, sf_dir):
    out = m13(spark, sf_dir)
    classes = the_classifier(spark, sf_dir).classes
    return out.agg(F.count(F.lit(1)).alias("events"),
                   F.count_if(~F.coalesce(F.col("predicted_attack").isin(*classes), F.lit(False))).alias("without_class"),
                   F.count_if(~F.col("confidence").between(1 / len(classes) - 1e-6, 1)).alias("outside_unit"))


@query("m14_importances")
def m14(spark, sf_dir):
    return the_classifier(spark, sf_dir).top_features(spark)


@query("m14_importances_sum", "SELECT 1.0::DOUBLE AS total")
def m14_sum(spark, sf_dir):
    names = engineered(spark, sf_dir)[2]
    return the_classifier(spark, sf_dir).top_features(spark, len(names)).agg(F.round(F.sum("importance"), 6).alias("total"))


@query("m15_model_comparison")
def m15(spark, sf_dir):
    data, train, names, fitted = engineered(spark, sf_dir)
    table, _ = classifier.compare(train, data.where(~fitted.cut.is_train()), names, {
        "Random Forest": classifier.random_forest(trees=100), "Boosted Trees": classifier.boosted_trees(rounds=100),
    })
    return table


@query("m18_inference_records")
def m18(spark, sf_dir):
    fitted = the_classifier(spark, sf_dir)
    top = [r["feature"] for r in fitted.top_features(spark, 5).collect()]
    return classifier.inference_records(fitted.predict(alerting(spark, sf_dir)), top).withColumn(
        "top_features", F.array_join("top_features", " | "))


@query("m18_same_by_sql", "SELECT CAST(0 AS BIGINT) AS different")
def m18_same(spark, sf_dir):
    """Records whose name, confidence or severity another statement of the rules does not give, or without three leading features."""
    fitted = the_classifier(spark, sf_dir)
    named = written(fitted.predict(alerting(spark, sf_dir)).select("event_id", "predicted_attack", "classifier_confidence"), "named")
    high = ", ".join(f"'{k}'" for k, v in V.ATTACK_SEVERITY.items() if v == "High") or "''"
    other = "CASE predicted_attack " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ATTACK_SEVERITY.items()) + f" ELSE '{V.ATTACK_SEVERITY_DEFAULT}' END"
    again = spark.sql(f"""SELECT event_id, replace(initcap(replace(predicted_attack, '_', ' ')), 'Low Slow', 'Low & Slow') AS a, round(classifier_confidence, 4) AS c,
      CASE WHEN classifier_confidence > 0.9 AND (predicted_attack IN ({high}) OR {other} = 'High') THEN 'Critical' ELSE {other} END AS s FROM {{named}}""", named=named)
    same = (F.col("attack_type") == F.col("a")) & (F.abs(F.col("confidence") - F.col("c")) < 1e-9) & (F.col("severity") == F.col("s")) & (
        F.size(F.split("top_features", " [|] ")) == 3)
    return m18(spark, sf_dir).join(again, "event_id", "full").agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("different"))


def _alerts(spark, sf_dir, rows):
    fitted = the_classifier(spark, sf_dir)
    return explain.alerts(fitted.predict(rows), fitted.features, fitted.importances())


_ALERT = ["user", "event_id", "attack", "confidence", "risk_score", "risk_level", "recommended_action"]


@query("e2_alerts")
def e2(spark, sf_dir):
    return _alerts(spark, sf_dir, alerting(spark, sf_dir)).select(*_ALERT, F.array_join("top_features", " | ").alias("top_features"))


_AGAIN = """
SELECT event_id, entity_id AS user, replace(initcap(replace(predicted_attack, '_', ' ')), 'Low Slow', 'Low & Slow') AS attack, round(classifier_confidence, 2) AS confidence,
  risk_score, CASE WHEN risk_score >= 90 THEN 'Critical' WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM (SELECT *, bround(greatest(0, least(100, CASE WHEN predicted_attack IN ({high}) AND base > 50 THEN greatest(base, 85)
    WHEN predicted_attack IN ({middle}) AND base > 40 THEN greatest(base, 70) ELSE base END)), 0) AS risk_score
  FROM (SELECT *, 40D * anomaly_score + 35D * classifier_confidence + 25D * least(1, risk_multiplier / 6) AS base FROM {{rows}}) q) q""".format(
    **{k: ", ".join(f"'{a}'" for a in v) for k, v in (("high", V.FLOOR_85_ATTACKS), ("middle", V.FLOOR_70_ATTACKS))})


def _alerts_differ(spark, sf_dir, rows):
    """Alerts whose name, confidence or risk another statement of the rules does not give."""
    named = written(the_classifier(spark, sf_dir).predict(rows), "named")
    fitted = the_classifier(spark, sf_dir)
    got = explain.alerts(named, fitted.features, fitted.importances())
    again = spark.sql(_AGAIN, rows=named).select("event_id", *[F.col(c).alias(f"_{c}") for c in ("user", "attack", "confidence", "risk_score", "risk_level")])
    same = F.lit(True)
    for c in ("user", "attack", "risk_level"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c in ("confidence", "risk_score"):
        same = same & (F.abs(F.col(c) - F.col(f"_{c}")) < 1e-9)
    return got.join(again, "event_id", "full").agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("different"))


@query("e2_same_by_sql", "SELECT CAST(0 AS BIGINT) AS different")
def e2_same(spark, sf_dir):
    return _alerts_differ(spark, sf_dir, alerting(spark, sf_dir))


def _anomalies_scored(spark, sf_dir):
    return the_detector(spark, sf_dir).score(engineered(spark, sf_dir)[0].where("label = 'anomaly'"))


@query("e6_combined_alerts")
def e6(spark, sf_dir):
    data, train, _, _ = engineered(spark, sf_dir)
    alerts = _alerts(spark, sf_dir, _anomalies_scored(spark, sf_dir))
    # Both sides are results in their own right: written, so that the join plans over two tables.
    combined = incident.combined_alerts(written(alerts, "alerts"), written(incident.assessed(data, train), "assessed"))
    return combined.select(*_ALERT, "dynamic_risk_engine.composite_risk_score",
                           "behavioral_identity_engine.deviation_percentage")


@query("e6_combined_events", "SELECT event_id, entity_id AS user FROM log WHERE label = 'anomaly'")
def e6_events(spark, sf_dir):
    return e6(spark, sf_dir).select("event_id", "user")


@query("e6_same_by_sql", "SELECT CAST(0 AS BIGINT) AS different")
def e6_same(spark, sf_dir):
    return _alerts_differ(spark, sf_dir, _anomalies_scored(spark, sf_dir))


@query("e7_sample_alerts")
def e7(spark, sf_dir):
    first = engineered(spark, sf_dir)[0].where("label = 'anomaly'").orderBy("timestamp", "event_id").limit(5)
    return _alerts(spark, sf_dir, the_detector(spark, sf_dir).score(first)).select(*_ALERT)


@query("e7_sampled_events", "SELECT event_id FROM log WHERE label = 'anomaly' ORDER BY timestamp, event_id LIMIT 5")
def e7_events(spark, sf_dir):
    return e7(spark, sf_dir).select("event_id")


def _reloaded(spark, sf_dir):
    path = scratch_path(spark, "models")
    the_detector(spark, sf_dir).save(spark, f"{path}/detector")
    the_classifier(spark, sf_dir).save(f"{path}/classifier")
    return detector.load_detector(spark, f"{path}/detector"), classifier.load_classifier(f"{path}/classifier")


@query("snk4_saved_models")
def snk4(spark, sf_dir):
    found, named = _reloaded(spark, sf_dir)
    return named.predict(found.score(engineered(spark, sf_dir)[0])).select(
        "event_id", r6("anomaly_score").alias("anomaly_score"), "alert_tier", "predicted_attack")


@query("snk4_same_after_reload", "SELECT count(*) AS events, CAST(0 AS BIGINT) AS different FROM log")
def snk4_same(spark, sf_dir):
    data = engineered(spark, sf_dir)[0]
    before = the_classifier(spark, sf_dir).predict(the_detector(spark, sf_dir).score(data)).select(
        "event_id", r6("anomaly_score").alias("score"), F.col("predicted_attack").alias("named"))
    both = snk4(spark, sf_dir).join(before, "event_id")
    return both.agg(F.count(F.lit(1)).alias("events"), F.count_if(
        ~(F.col("anomaly_score").eqNullSafe(F.col("score")) & F.col("predicted_attack").eqNullSafe(F.col("named")))).alias("different"))
