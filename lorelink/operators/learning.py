"""History, feedback, evaluation, training and scoring."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as kinds
from pyspark.ml import feature as steps
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)

#: Estimators and preprocessors by the names that requests may use.
CLASSIFIERS = {"RandomForestClassifier": kinds.RandomForestClassifier, "LogisticRegression": kinds.LogisticRegression, "LinearSVC": kinds.LinearSVC, "SVC": kinds.LinearSVC, "GradientBoostingClassifier": kinds.GBTClassifier, "GBTClassifier": kinds.GBTClassifier, "DecisionTreeClassifier": kinds.DecisionTreeClassifier, "SGDClassifier": kinds.LogisticRegression, "NaiveBayes": kinds.NaiveBayes}
PREPROCESSORS = {"StandardScaler": steps.StandardScaler, "MinMaxScaler": steps.MinMaxScaler, "MaxAbsScaler": steps.MaxAbsScaler, "RobustScaler": steps.RobustScaler, "Normalizer": steps.Normalizer}


def coerced(value: str) -> Any:
    """A number if the text is one, else the text."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def context_of(path: str) -> tuple[str, str | None]:
    """A feedback path as context and request id: its last part is an id if it looks like one."""
    head, _, last = path.strip("/").rpartition("/")
    return (head, last) if UUID.match(last) else (path.strip("/"), None)


def context_from_file(path: Column, pattern: str = r"([^/]+?)(?:\.[^./]*)?$") -> Column:
    return F.regexp_extract(path, pattern, 1)


def in_context(history: DataFrame, context: str) -> DataFrame:
    """History below a context; a plain prefix, so the scan can use it."""
    return history.where(F.col("context").startswith(context))


# --- feedback ---


def unplaced_feedback(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """The rows of feedback (request_id, context and more) that can't be meant for anything in the history, with `reason`.

    A request that is named must be one of the context that is named, or of the history where none is; a context by itself
    must have requests. Rows that name neither are for nothing. The history is brought to one row a request before it is joined.
    """
    known = history.select(F.col("context").alias("_c"), F.col("request_id").alias("_r")).distinct()
    seen = {"_both": known, "_request": known.select("_r").distinct(), "_context": known.select("_c").distinct()}
    on = {"_both": (F.col("context") == F.col("_c")) & (F.col("request_id") == F.col("_r")), "_request": F.col("request_id") == F.col("_r"), "_context": F.col("context") == F.col("_c")}
    out = feedback
    for name, rows in seen.items():
        out = out.join(rows.where(F.col(rows.columns[0]).isNotNull()).withColumn(name, F.lit(True)), on[name], "left").drop("_c", "_r")
    named, placed = F.col("request_id").isNotNull(), F.col("context").isNotNull()
    reason = F.when(named & placed & F.col("_both").isNull(), "request isn't in context").when(named & ~placed & F.col("_request").isNull(), "no such request").when(~named & F.col("_context").isNull(), "no requests in context")
    return out.withColumn("reason", reason).where("reason IS NOT NULL").drop(*seen)


def with_feedback(history: DataFrame, feedback: DataFrame, types: list[str], default: str | None = None) -> DataFrame:
    """history with `feedback`: the first of `types` that the link's id has in its context (and request, where one is named), else default.

    feedback: context, type, id and perhaps request_id. The matches are brought to one row a link before the join.
    """
    rank = F.create_map(*[y for k, t in enumerate(types) for y in (F.lit(t), F.lit(k))])
    given = feedback.where(F.col("type").isin(types)).withColumn("_rank", rank[F.col("type")])
    one = lambda df, key: df.groupBy(*key).agg(F.min(F.struct("_rank", "type"))["type"].alias("_type"))
    if "request_id" in feedback.columns:
        named = one(given.where("request_id IS NOT NULL"), ["request_id", "id"])
        wide = one(given.where("request_id IS NULL"), ["context", "id"]).withColumnRenamed("_type", "_wide")
        both = history.join(named, ["request_id", "id"], "left").join(wide, ["context", "id"], "left")
        return both.withColumn("feedback", F.coalesce("_type", "_wide", F.lit(default))).drop("_type", "_wide")
    return history.join(one(given, ["context", "id"]), ["context", "id"], "left").withColumn("feedback", F.coalesce("_type", F.lit(default))).drop("_type")


# --- evaluation ---


def context_counts(history: DataFrame) -> DataFrame:
    """context (null: all), requests, links, missing, and by_type: feedback of each type; both levels in one pass."""
    per = history.groupBy("context", "request_id", "feedback").agg(F.count("*").alias("n"))
    sums = per.select("context", "request_id", "feedback", "n", F.explode(F.array(F.lit(None).cast("string"), "context")).alias("scope"), F.col("n").alias("_n"))
    sums = sums.withColumn("total", F.col("scope").isNull())
    by_type = sums.where("feedback IS NOT NULL").groupBy("total", "scope", "feedback").agg(F.sum("n").alias("n")).groupBy("total", "scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feedback", "n")))).alias("by_type"))
    main = sums.groupBy("total", "scope").agg(F.countDistinct("request_id").alias("requests"), F.sum("n").alias("links"), F.sum(F.when(F.col("feedback").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    out = main.alias("a").join(by_type.alias("b"), (F.col("a.total") == F.col("b.total")) & F.col("a.scope").eqNullSafe(F.col("b.scope")), "left")
    return out.select(F.col("a.scope").alias("context"), "requests", "links", "missing", F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type"))


METRICS = ("accuracy", "zero_one_loss", "precision", "recall", "f1", "average_precision", "roc_auc", "r_precision")


def classification_metrics(scored: DataFrame, key: list[str], threshold: float = 0.5) -> DataFrame:
    """key and METRICS of rows with label (boolean) and score; precision, recall and f1 weighted by class size.

    A row is called positive above the threshold. Rank metrics go by descending score, rows with one score together;
    R-precision takes as many of the best as there are positives, ties among them counted in part. Null where a class is
    missing that the metric needs.
    """
    rows = scored.where("label IS NOT NULL").select(*key, F.col("label").cast("int").alias("y"), "score")
    levels = rows.groupBy(*key, "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    line = Window.partitionBy(*key).orderBy(F.desc("score"))
    whole = Window.partitionBy(*key)
    upto = levels.withColumns({"seen": F.sum("n").over(line), "hits": F.sum("pos").over(line), "all": F.sum("n").over(whole), "positives": F.sum("pos").over(whole)})
    before, neg = F.col("seen") - F.col("n"), F.col("n") - F.col("pos")
    negatives = F.col("all") - F.col("positives")
    above = F.col("score") > threshold
    share_in = F.greatest(F.lit(0), F.least(F.col("n"), F.col("positives") - before)) / F.col("n")
    sums = upto.groupBy(*key).agg(
        F.max("all").alias("all"),
        F.max("positives").alias("positives"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
        F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("ap"),
        F.sum(F.col("pos") * (negatives - (before - (F.col("hits") - F.col("pos"))) - neg + neg / 2)).alias("auc"),
        F.sum(F.col("pos") * share_in).alias("r"),
    )
    tp, fp, p, n = F.col("tp"), F.col("fp"), F.col("positives"), F.col("all") - F.col("positives")
    fn, tn = p - tp, n - fp
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    mean = lambda a, b: (p * a + n * b) / (p + n)
    f = lambda a, b, c: div(2 * a, 2 * a + b + c)
    accuracy = (tp + tn) / (p + n)
    return sums.select(*key, accuracy.alias("accuracy"), (1 - accuracy).alias("zero_one_loss"), mean(div(tp, tp + fp), div(tn, tn + fn)).alias("precision"), mean(div(tp, p), div(tn, n)).alias("recall"), mean(f(tp, fp, fn), f(tn, fn, fp)).alias("f1"), F.try_divide("ap", p).alias("average_precision"), F.try_divide("auc", p * n).alias("roc_auc"), F.try_divide("r", p).alias("r_precision"))


def evaluate(history: DataFrame, context: str = "", target: str = "positive", heuristic: str = "senseProbability", threshold: float = 0.5) -> DataFrame:
    """scope (micro, macro or context), context, metric, value of the history below a context.

    Micro pools all rows, macro is the mean over contexts that have the metric.
    """
    rows = in_context(history, context).where("feedback IS NOT NULL").select("context", (F.col("feedback") == target).alias("label"), F.col(heuristic).alias("score"))
    per = classification_metrics(rows, ["context"], threshold)
    pooled = classification_metrics(rows.withColumn("_all", F.lit(1)), ["_all"], threshold)
    tall = lambda df, scope, name: df.select(F.lit(scope).alias("scope"), name.alias("context"), F.explode(F.create_map(*[y for m in METRICS for y in (F.lit(m), F.col(m))])).alias("metric", "value"))
    contexts = tall(per, "context", F.col("context"))
    macro = contexts.groupBy("metric").agg(F.avg("value").alias("value")).select(F.lit("macro").alias("scope"), F.lit(None).cast("string").alias("context"), "metric", "value")
    return tall(pooled, "micro", F.lit(None).cast("string")).unionAll(macro).unionAll(contexts)


# --- models ---


def feature_gaps(model: list[str], available: list[str], tolerate: bool = False) -> list[str]:
    """Sorted features that the model needs and the links lack; an error, unless that is tolerated."""
    gaps = sorted(set(model) - set(available))
    if gaps and not tolerate:
        raise ValueError(f"features are missing: {', '.join(gaps)}")
    return gaps


def create(name: str, known: dict[str, Any], args: dict[str, str] | None = None) -> Any:
    """An estimator of the list by its name; arguments by their name there, numbers as numbers."""
    if name not in known:
        raise ValueError(f"{name} isn't one of {', '.join(sorted(known))}")
    made = known[name]()
    for key, value in (args or {}).items():
        value = coerced(value) if isinstance(value, str) else value
        wanted = {"n_estimators": "numTrees", "max_depth": "maxDepth", "random_state": "seed"}.get(key, key)
        if made.hasParam(wanted):
            made.set(made.getParam(wanted), made.getParam(wanted).typeConverter(value))
        else:
            raise ValueError(f"{name} has no argument {key}")
    return made


@dataclass
class Model:
    """A fitted pipeline, the features it reads in their order, and what is told about it."""

    pipeline: PipelineModel
    features: list[str]
    about: dict[str, Any] = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
        session.createDataFrame([(json.dumps({"features": self.features, **self.about}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> Model:
        from pyspark.sql import SparkSession

        about = json.loads(SparkSession.getActiveSession().read.text(f"{path.removesuffix('.pkl')}/about").first()[0])
        return cls(PipelineModel.load(f"{path.removesuffix('.pkl')}/pipeline"), about.pop("features"), about)


def training_set(history: DataFrame, context: str = "", target: str = "positive") -> DataFrame:
    """Rows with feedback below a context: request_id, id, label column and the features as columns."""
    return in_context(history, context).where("feedback IS NOT NULL").withColumn("label", (F.col("feedback") == target).cast("double"))


def counters(rows: DataFrame) -> DataFrame:
    """requests, links, positives and the share of positives of a training set."""
    return rows.agg(F.countDistinct("request_id").alias("requests"), F.count("*").alias("links"), F.sum("label").cast("long").alias("positives"), F.avg("label").alias("balance"))


def learn(name: str, history: DataFrame, features: list[str], context: str = "", target: str = "positive", classifier: str = "RandomForestClassifier", args: dict[str, str] | None = None, preprocessor: str | None = None, preprocessor_args: dict[str, str] | None = None) -> Model:
    """Fit a classifier to the history below a context. In forests positives weigh the share of negatives and the reverse."""
    features = sorted(features)
    rows = training_set(history, context, target)
    rows = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    told = counters(rows).first().asDict()
    args = dict(args or {})
    if "C" in args:  # the inverse of the penalty, against a sum of losses where regParam is against their mean
        args["regParam"] = str(1 / (float(args.pop("C")) * max(1, told["links"])))
    estimator = create(classifier, CLASSIFIERS, args)
    if classifier == "RandomForestClassifier":
        balance = told["balance"] or 0.0
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, 1 - balance).otherwise(balance))
        estimator.setWeightCol("weight")
    stages: list[Any] = [VectorAssembler(inputCols=features, outputCol="assembled")]
    if preprocessor:
        stages.append(create(preprocessor, PREPROCESSORS, preprocessor_args).setInputCol("assembled").setOutputCol("scaled"))
    estimator.setFeaturesCol("scaled" if preprocessor else "assembled").setLabelCol("label")
    return Model(Pipeline(stages=[*stages, estimator]).fit(rows), features, {"name": name, "classifier": classifier, "preprocessor": preprocessor, **told})


def refit(model: Model, history: DataFrame, **how: Any) -> Model:
    """Go on learning: there is no update in place, so the model is fitted anew to the whole history."""
    return learn(model.about["name"], history, model.features, classifier=model.about["classifier"], preprocessor=model.about["preprocessor"], **how)


def score(links: DataFrame, model: Model, tolerate: bool = False) -> DataFrame:
    """links with learningProbability: the model's probability, or its raw score where it has none. Features that are missing count as 0, if that is tolerated."""
    gaps = feature_gaps(model.features, links.columns, tolerate)
    saved = {f: f"_own_{f}" for f in model.features if f not in gaps}
    x = links.withColumns({new: F.col(old) for old, new in saved.items()}).withColumns({f: F.lit(0.0) if f in gaps else F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.features})
    out = model.pipeline.transform(x)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    out = out.withColumn("learningProbability", vector_to_array(column)[1])
    out = out.withColumns({old: F.col(new) for old, new in saved.items()})
    return out.select(*links.columns, "learningProbability")


def leave_one_out(contexts: list[str], seed: int = 0, rounds: int = 50) -> list[tuple[str, list[str]]]:
    """For each round a context that is left out, drawn with a seed, and the others."""
    import random

    draw = random.Random(seed)
    return [(out := draw.choice(contexts), [c for c in contexts if c != out]) for _ in range(rounds)] if contexts else []


def append_history(links: DataFrame, path: str) -> None:
    """Add links to the history table."""
    links.write.mode("append").parquet(path)
