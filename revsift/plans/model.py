"""A learned rule: which entities drift, from features, with MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.common import cut
from revsift.operators import retrieval

KINDS = ("logistic", "elastic", "svm", "tree", "shallow_tree", "forest", "large_forest", "boosted", "slow_boosted", "bayes", "perceptron")


def aligned(features: DataFrame, names: list[str]) -> DataFrame:
    """features with exactly the columns `names` beside the others: missing ones are 0, nulls too."""
    return features.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in features.columns else F.lit(0.0) for n in names})


def _made(kind: str, seed: int, width: int):
    common = {"featuresCol": "scaled", "weightCol": "weight"}
    return {
        "logistic": lambda: LogisticRegression(**common, maxIter=50),
        "elastic": lambda: LogisticRegression(**common, maxIter=50, regParam=0.01, elasticNetParam=0.5),
        "svm": lambda: LinearSVC(**common, maxIter=50, regParam=0.01),
        "tree": lambda: DecisionTreeClassifier(**common, maxDepth=8, seed=seed),
        "shallow_tree": lambda: DecisionTreeClassifier(**common, maxDepth=3, seed=seed),
        "forest": lambda: RandomForestClassifier(**common, numTrees=40, seed=seed),
        "large_forest": lambda: RandomForestClassifier(**common, numTrees=100, maxDepth=10, seed=seed),
        "boosted": lambda: GBTClassifier(**common, maxIter=20, seed=seed),
        "slow_boosted": lambda: GBTClassifier(**common, maxIter=40, stepSize=0.05, seed=seed),
        "bayes": lambda: NaiveBayes(**common, modelType="gaussian"),
        "perceptron": lambda: MultilayerPerceptronClassifier(featuresCol="scaled", layers=[width, 16, 2], maxIter=60, seed=seed),
    }[kind]()


def train(rows: DataFrame, names: list[str], label: str, kind: str = "logistic", seed: int = 42) -> PipelineModel:
    """Scaled features into a classifier of one of KINDS; classes are weighed to be equal. Null labels don't count."""
    x = aligned(rows, names).withColumn("label", F.col(label).cast("double")).where("label is not null")
    share = x.agg(F.avg("label")).first()[0] or 0.0
    x = x.withColumn("weight", F.when(F.col("label") > 0, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), _made(kind, seed, len(names))]).fit(x)


def scored(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with score, the probability of the positive class; a margin model's is the logistic function of its margin. A model
    that saw only negatives scores 0."""
    x = model.transform(aligned(rows, names))
    if "probability" in x.columns:
        p = vector_to_array("probability")
        score = F.when(F.size(p) > 1, F.get(p, 1)).otherwise(0.0)
    else:
        score = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), 1)))
    return x.withColumn("score", score).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def predicted(model: PipelineModel, rows: DataFrame, names: list[str], threshold: float = 0.5) -> DataFrame:
    return scored(model, rows, names).withColumn("predicted", F.col("score") >= threshold)


def out_of_fold(rows: DataFrame, names: list[str], label: str, group: str, kind: str = "logistic", folds: int = 5, seed: int = 42) -> DataFrame:
    """rows with score, each from a model that saw no row of its group. Groups are dealt to folds by hash; a fold whose other
    rows have one class only is scored by that class."""
    x = cut(rows.withColumn("_fold", F.expr(f"pmod(xxhash64(`{group}`, {seed}), {folds})")), "folds")
    out = None
    for i in range(folds):
        rest, held = x.where(F.col("_fold") != i), x.where(F.col("_fold") == i)
        kinds = [r[0] for r in rest.select(F.col(label).cast("boolean").alias("y")).where("y is not null").distinct().collect()]  # two at most
        s = scored(train(rest, names, label, kind, seed), held, names) if len(kinds) == 2 else held.withColumn("score", F.lit(float(kinds == [True])))
        s = s.select(*rows.columns, "score")
        out = s if out is None else out.unionByName(s)
    return cut(out, "out-of-fold")


def fitted_threshold(rows: DataFrame, names: list[str], label: str, group: str, target_recall: float | None = None, kind: str = "logistic", folds: int = 5) -> float:
    """The cut on out-of-fold scores: of the best F1, or the highest that reaches the wanted recall; 0.5 at most."""
    s = out_of_fold(rows, names, label, group, kind, folds).withColumn("_y", F.col(label).cast("boolean"))
    return float(retrieval.best_threshold(retrieval.pr_curve(s, "score", "_y"), target_recall).first()[0])


def evaluation(rows: DataFrame, label: str, threshold: float, score: str = "score") -> DataFrame:
    """One row: counts of the four outcomes, accuracy, precision, recall, F1, average precision and area under the ROC curve.
    What divides by nothing is 0."""
    x = cut(rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("boolean").alias("y"), F.col(score).alias("s")), "scored")
    hit = F.col("s") >= threshold
    c = x.agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"), F.count_if(~hit & ~F.col("y")).alias("tn"))
    curve = cut(retrieval.pr_curve(x, "s", "y"), "curve")
    # ROC by trapezoids: each distinct score adds its negatives times the mean of the positives before and after them
    steps = retrieval.running(curve.withColumns({"_n": F.col("flagged") - F.col("true_positives")}), [F.desc("threshold")], {"_tp": ("max", "true_positives"), "_fp": ("max", "_n")}, before=True)
    zero = F.lit(0)
    area = steps.agg(F.sum((F.col("_n") - F.coalesce("_fp", zero)) * (F.col("true_positives") + F.coalesce("_tp", zero)) / 2).alias("_area"))
    r = c.crossJoin(F.broadcast(retrieval.average_precision(curve))).crossJoin(F.broadcast(area))  # one row each
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    p, q = over(tp, tp + fp), over(tp, tp + fn)
    return r.select(
        "tp", "fp", "fn", "tn", over(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), q.alias("recall"), over(2 * p * q, p + q).alias("f1"),
        F.coalesce("average_precision", F.lit(0.0)).alias("average_precision"), over(F.col("_area"), (tp + fn) * (fp + tn)).alias("roc_auc"),
    )


def importance(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """(feature, weight) by falling weight: of a tree its importances, of a linear model the sizes of its coefficients; zeros
    where a kind has neither."""
    m = model.stages[-1]
    w = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray()) if hasattr(m, "coefficients") else [0.0] * len(names)
    return sorted(zip(names, map(float, w)), key=lambda x: (-x[1], x[0]))


def permutation_importance(model: PipelineModel, rows: DataFrame, names: list[str], label: str, seed: int = 42) -> DataFrame:
    """(feature, baseline, permuted, importance): by how much average precision falls when a column's values are dealt anew.

    Values are permuted by pairing two orders of the rows, sorted over range partitions; one job a feature."""
    x = cut(aligned(rows, names).withColumn("_y", F.col(label).cast("boolean")).where("_y is not null").withColumn("_i", F.monotonically_increasing_id()).withColumn("_one", F.lit(1)), "rows")
    ap = lambda d: float(retrieval.average_precision(retrieval.pr_curve(scored(model, d, names), "score", "_y")).first()[0] or 0.0)
    base, out = ap(x), []
    at = cut(retrieval.running(x.select("_i", "_one"), [F.col("_i")], {"_k": ("sum", "_one")}).select("_i", "_k"), "places")
    for j, c in enumerate(names):
        other = retrieval.running(x.select("_i", "_one", F.col(c).alias("_v")), [F.xxhash64("_i", F.lit(seed + j)), F.col("_i")], {"_k": ("sum", "_one")}).select("_k", "_v")
        got = ap(x.drop(c).join(at, "_i").join(other, "_k").withColumnRenamed("_v", c))
        out.append((c, base, got, base - got))
    return rows.sparkSession.createDataFrame(out, "feature string, baseline double, permuted double, importance double")


def compared(train_rows: DataFrame, test_rows: DataFrame, names: list[str], label: str, group: str, kinds: tuple[str, ...] = KINDS, target_recall: float | None = None) -> DataFrame:
    """(kind, threshold, evaluation): each kind trained, cut by its own out-of-fold threshold, and evaluated on the test rows."""
    out = None
    for k in kinds:
        t = fitted_threshold(train_rows, names, label, group, target_recall, k)
        e = evaluation(scored(train(train_rows, names, label, k), test_rows, names), label, t).select(F.lit(k).alias("kind"), F.lit(t).alias("threshold"), "*")
        out = e if out is None else out.unionByName(e)
    return out


def save(model: PipelineModel, path: str, names: list[str], threshold: float) -> None:
    """The model and, beside it, its features and threshold."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(names, float(threshold))], "names array<string>, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def restore(spark, path: str) -> tuple[PipelineModel, list[str], float]:
    """(model, features, threshold) as saved; a missing path raises."""
    about = spark.read.json(f"{path}/about").first()
    return PipelineModel.load(f"{path}/model"), list(about["names"]), about["threshold"]


def scores_by_anchor(model: PipelineModel, names: list[str], state: DataFrame, entities: DataFrame, edges: DataFrame, order: DataFrame, commit: str) -> DataFrame:
    """(entity_id, score) of a commit's entities, each by the features against the commit that it is cached at (state: entity_id,
    anchor_commit). New entities and those cached at this commit score 0. All anchors in one plan: a pair of commits for each."""
    from revsift.operators import features, staleness

    own = cut(features.anchored_pairs(state, entities, commit), "anchored")
    pairs = cut(own.select("commit_before", "commit_after").distinct(), "pairs")
    modified = staleness.changed_entities(entities, pairs)
    x = features.pair_features(pairs, entities, edges, modified, order).join(own, features.KEY, "left_semi")
    s = scored(model, x, names).select("entity_id", "score")
    here = entities.where(F.col("commit_hash") == commit).select("entity_id").distinct()
    return here.join(s, "entity_id", "left").select("entity_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def newest(spark: SparkSession, base: str) -> str:
    """The folder below base that a model was last saved in; none is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/*/about")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    if not len(found):
        raise FileNotFoundError(f"no model below {base}")
    return max(found, key=lambda f: (f.getModificationTime(), f.getPath().toString())).getPath().getParent().toString()


def ingestion_pipeline(files: DataFrame, model: PipelineModel | None, names: list[str], modified: DataFrame, commit: str, before: DataFrame | None = None, threshold: float = 0.02) -> DataFrame:
    """Rows to ingest of files (commit_hash, file_path, content): parsed, with their calls, and kept if they were modified
    (entity_id) or their score against the commit before them reaches the threshold. before (commit_before, commit_after)."""
    from revsift.functions import code
    from revsift.operators import features, staleness

    e = cut(code.parse_entities(files), "entities")
    calls = cut(code.call_edges(e, code.imports(files)), "calls")
    nodes = staleness.ingestion_rows(e, calls).where(F.col("commit_hash") == commit)
    scores = e.select(F.col("entity_id").alias("id"), F.lit(0.0).alias("score")).where("false")
    if model is not None and before is not None:
        m = before.join(modified.select("entity_id"), how="cross") if before.limit(2).count() == 1 else modified  # one pair
        x = features.pair_features(before, e, calls, m, before.withColumn("seq", F.lit(0)))
        scores = scored(model, x, names).select(F.col("entity_id").alias("id"), "score")
    return staleness.kept_nodes(nodes, scores, modified.select(F.col("entity_id").alias("id")), threshold)
