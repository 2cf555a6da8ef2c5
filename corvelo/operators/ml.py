"""Text classifiers on TF-IDF features: training, folds, thresholds, scoring."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvelo.session import cut_lineage, cut_size, drop_cut

#: Bytes of written features in a part that a classifier reads at once.
PART = 16 * 2**20


def feature_text(title: Column, abstract: Column, rules: Column, venue: Column | None = None) -> Column:
    """Whether a rule matched, a token per matched rule, then title and abstract, with a venue token if wanted."""
    rules = F.coalesce(rules, F.array().cast("array<string>"))
    # The tokens and the layout.
    head = F.concat(F.when(F.size(rules) > 0, "RULE_POSITIVE").otherwise("RULE_NEGATIVE"), F.lit(" "), F.array_join(F.transform(rules, lambda r: F.concat(F.lit("RULE_DIM_"), r)), " "))
    lines = [head, F.concat(F.lit("TITLE: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("ABSTRACT: "), F.coalesce(abstract, F.lit("")))]
    return F.concat_ws("\n", *lines, *([F.concat(F.lit("VENUE: "), venue)] if venue is not None else []))


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts n of a sparse vector as 1 + log n; Spark's own transformers leave counts as they are."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # a vector's parts are read in the JVM; JSON is the built-in way back to a vector
        parts = F.unwrap_udt(self.getInputCol())
        logs = F.transform(parts["values"], lambda n: 1 + F.log(n))
        text = F.to_json(F.struct(F.struct(parts["type"].alias("type"), parts["size"].alias("size"), parts["indices"].alias("indices"), logs.alias("values")).alias("v")))
        return dataset.withColumn(self.getOutputCol(), F.from_json(text, StructType([StructField("v", VectorUDT())]))["v"])


def word_letters(text: str, low: int, high: int) -> str:
    """SQL of the runs of `low` to `high` letters inside words, a space before and after each word."""
    words = rf"filter(split(regexp_replace(lower({text}), '(?U)\\W+', ' '), ' '), w -> w <> '')"
    runs = ", ".join(f"transform(sequence(1, greatest(length(w) - {n - 1}, 1)), i -> substring(w, i, {n}))" for n in range(low, high + 1))
    return f"flatten(transform(transform({words}, w -> concat(' ', w, ' ')), w -> concat({runs})))"


def token_stages(text: str, letters: tuple[int, int] | None = (3, 5)) -> list[Transformer]:
    """Words and word pairs (`_terms`), and runs of `letters` inside words (`_letters`) unless None; nothing is fitted."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    stages = [tokens, pairs, SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")]
    if letters:
        stages.append(SQLTransformer(statement=f"SELECT *, {word_letters(text, *letters)} AS _letters FROM __THIS__"))
    return stages


def vector_stages(letters: tuple[int, int] | None = (3, 5), vocabulary: int = 20_000, min_df: float = 2, max_df: float = 0.98) -> list:
    """TF-IDF (`features`) of 1 + log n counts of the tokens, each of the `vocabulary` most frequent terms within
    `min_df` rows and the share `max_df`."""
    stages, sets = [], [("_terms", max_df), *([("_letters", float(2**31))] if letters else [])]
    for c, most in sets:
        stages += [CountVectorizer(inputCol=c, outputCol=f"{c}_counts", vocabSize=vocabulary, minDF=min_df, maxDF=most), LogCounts(inputCol=f"{c}_counts", outputCol=f"{c}_logs"), IDF(inputCol=f"{c}_logs", outputCol=f"{c}_idf"), Normalizer(inputCol=f"{c}_idf", outputCol=f"{c}_unit")]
    return [*stages, VectorAssembler(inputCols=[f"{c}_unit" for c, _ in sets], outputCol="features")]


def classifier(label: str, kind: str = "logistic", weight: str = "weight", cost: float = 0.003, rounds: int = 20, depth: int = 4) -> LogisticRegression | GBTClassifier:
    """Class-weighted logistic regression (`cost` is the regularisation) or boosted trees (`rounds`, `depth`)."""
    if kind == "logistic":
        return LogisticRegression(labelCol=label, weightCol=weight, regParam=cost, maxIter=50)
    return GBTClassifier(labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=depth, seed=42)


#: The parameters of `vector_stages`; the others are those of `classifier`.
_OF_VECTORS = ("letters", "vocabulary", "min_df", "max_df")


def _parted(parameters: dict) -> tuple[dict, dict]:
    """Parameters of the vectors and those of the classifier."""
    return {k: v for k, v in parameters.items() if k in _OF_VECTORS}, {k: v for k, v in parameters.items() if k not in _OF_VECTORS}


def text_pipeline(text: str, label: str, kind: str = "logistic", **parameters) -> Pipeline:
    """`token_stages`, `vector_stages` and `classifier` with their parameters."""
    of_vectors, of_classifier = _parted(parameters)
    letters = of_vectors.get("letters", (3, 5))
    return Pipeline(stages=[*token_stages(text, letters), *vector_stages(**of_vectors), classifier(label, kind, **of_classifier)])


def balanced(frame: DataFrame, label: str) -> DataFrame:
    """Adds `weight`: rows over twice the rows of the label."""
    sizes = frame.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # a row a label
    return frame.join(F.broadcast(weights), label)


def tokenized(frame: DataFrame, text: str, keep: list[str], letters: tuple[int, int] | None = (3, 5)) -> DataFrame:
    """`keep` and the tokens of the text, written once in as many parts as there are tasks at a time."""
    session = frame.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    rows = PipelineModel(token_stages(text, letters)).transform(frame.select(*keep, text).repartition(tasks))
    return cut_lineage(rows.select(*keep, "_terms", *(["_letters"] if letters else [])))


def _vectors(tokens: DataFrame, label: str, **parameters) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fitted `vector_stages`, the written features, labels and weights of the rows, and the same in as few
    parts as their bytes ask for: a classifier reads them some fifty times, and each turn costs by the part and
    by what stands before it."""
    fitted = Pipeline(stages=vector_stages(**parameters)).fit(tokens)
    written = cut_lineage(fitted.transform(balanced(tokens, label)).select("features", label, "weight"))
    return fitted, written, written.coalesce(max(1, -(-cut_size(written) // PART)))


def _at_once(do: Callable, items: list, threads: int) -> list:
    """`do` of every item, some at a time, as small fits wait for the driver most of the time."""
    session = SparkSession.getActiveSession()
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(session)(do) if session else do, items, chunksize=1)


def train(frame: DataFrame, text: str, label: str, kind: str = "logistic", **parameters) -> PipelineModel:
    """A fitted pipeline. Tokens and features are written once, as the stages of the fit read them again."""
    of_vectors, of_classifier = _parted(parameters)
    letters = of_vectors.get("letters", (3, 5))
    tokens = tokenized(frame, text, [label], letters)
    fitted, written, features = _vectors(tokens, label, **of_vectors)
    last = classifier(label, kind, **of_classifier).fit(features)
    drop_cut(tokens, written)
    return PipelineModel([*token_stages(text, letters), *fitted.stages, last])


def score(model: PipelineModel, frame: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(frame).select(*keep, vector_to_array("probability")[1].alias("probability"))


def _scored_apart(seen: DataFrame, unseen: DataFrame, label: str, keep: list[str], kind: str, combinations: list[dict]) -> list[DataFrame]:
    """Tokenized rows `unseen` scored by models of the tokenized rows `seen`, for each of the combinations of
    parameters; those that differ in the classifier only share their vectors."""
    found, made = [], {}
    for parameters in combinations:
        of_vectors, of_classifier = _parted(parameters)
        at = repr(sorted(of_vectors.items()))
        if at not in made:
            fitted, written, features = _vectors(seen, label, **of_vectors)
            made[at] = written, cut_lineage(fitted.transform(unseen).select(*keep, "features")), features
        _, others, features = made[at]
        last = classifier(label, kind, **of_classifier).fit(features)
        found.append(cut_lineage(last.transform(others).select(*keep, vector_to_array("probability")[1].alias("probability"))))
    drop_cut(*(frame for written, others, _ in made.values() for frame in (written, others)))
    return found


def _cross_scored(tokens: DataFrame, label: str, fold: str, keep: list[str], kind: str, combinations: list[dict]) -> list[DataFrame]:
    """`cross_scored` of tokenized rows for each combination of parameters."""
    names = [k for (k,) in tokens.where(F.col(fold).isNotNull()).select(fold).distinct().orderBy(fold).collect()]
    parts = _at_once(lambda k: _scored_apart(tokens.where(F.col(fold) != k), tokens.where(F.col(fold) == k), label, keep, kind, combinations), names, 4)
    return [reduce(DataFrame.unionByName, of_one) for of_one in zip(*parts)]


def cross_scored(frame: DataFrame, text: str, label: str, fold: str, keep: list[str], kind: str = "logistic", **parameters) -> DataFrame:
    """Every row scored by a model that did not see its fold; the folds' names are few. Tokens are written once
    for all folds."""
    tokens = tokenized(frame, text, list(dict.fromkeys([*keep, label, fold])), parameters.get("letters", (3, 5)))
    scored = _cross_scored(tokens, label, fold, keep, kind, [parameters])[0]
    drop_cut(tokens)
    return scored


def classify_corpus(model: PipelineModel, corpus: DataFrame, text: str, threshold: float, keep: list[str]) -> DataFrame:
    """Scores where there is text; rows without it pass as `unclassified`, not as negatives."""
    held = F.length(F.coalesce(text, F.lit(""))) > 0
    scored = score(model, corpus.where(held), keep).withColumn("predicted_label", F.when(F.col("probability") >= threshold, "positive").otherwise("negative"))
    rest = corpus.where(~held).select(*keep, F.lit(None).cast("double").alias("probability"), F.lit("unclassified").alias("predicted_label"))
    return scored.unionByName(rest)


def best_threshold(scored: DataFrame, label: str, score_column: str = "probability", low: float = 0.1, high: float = 0.9, steps: int = 161) -> dict[str, float]:
    """Threshold, precision, recall and F1 of the grid's best by the lower of precision and recall, then F1,
    then nearness to one half. The grid's rows reach the driver."""
    from corvelo.operators.evaluate import threshold_grid

    grid = threshold_grid(scored.withColumn("_t", F.col(label) == 1), "_t", score_column, low, high, steps)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    rows = [r.asDict() for r in grid.withColumn("f1", f1).select("threshold", "precision", "recall", "f1").collect()]
    return max(rows, key=lambda r: (min(r["precision"], r["recall"]), r["f1"], -abs(r["threshold"] - 0.5)))


def nested_selection(frame: DataFrame, text: str, label: str, id_: str, grid: dict[str, list], outer: int = 5, inner: int = 4, kind: str = "logistic", strata: list[str] | None = None) -> DataFrame:
    """Every row scored with parameters and a threshold that were chosen without its fold: rows (id, label,
    fold, probability, threshold, predicted). In every outer fold each combination of `grid` is cross-scored over
    `inner` folds of the rest and the best by `best_threshold` is trained on all of the rest. Folds are in
    hash order within `strata` (the label by default)."""
    from corvelo.operators.sampling import folds
    strata = strata or [label]
    combinations = [dict(zip(grid, values)) for values in product(*grid.values())]
    # the folds of all turns are columns of one table, so that texts are taken apart once
    rows = folds(frame.select(id_, text, *dict.fromkeys([label, *strata])), strata, id_, outer).withColumnRenamed("fold", "_outer")
    rows = rows.withColumn("_inner", F.concat(F.lit("inner|"), F.col(id_).cast("string")))
    for k in range(outer):
        rows = folds(rows.withColumn("_rest", F.col("_outer") != k), [*strata, "_rest"], "_inner", inner).withColumnRenamed("fold", f"_inner_{k}")
    keep = [*dict.fromkeys([id_, label]), "_outer", *(f"_inner_{k}" for k in range(outer))]
    rows = cut_lineage(rows.select(*keep, text))
    tokens = {letters: tokenized(rows, text, keep, letters) for letters in {c.get("letters", (3, 5)) for c in combinations}}

    def turn(k: int) -> DataFrame:
        tried = []
        for letters, of_all in tokens.items():
            like = [c for c in combinations if c.get("letters", (3, 5)) == letters]
            crossed = _cross_scored(of_all.where(F.col("_outer") != k), label, f"_inner_{k}", [id_, label], kind, like)
            tried += [(best_threshold(of_one, label), parameters) for of_one, parameters in zip(crossed, like)]
        tried.sort(key=lambda t: combinations.index(t[1]))  # of equal ones the first of the grid
        best, parameters = max(tried, key=lambda t: (min(t[0]["precision"], t[0]["recall"]), t[0]["f1"]))
        of_all = tokens[parameters.get("letters", (3, 5))]
        part = _scored_apart(of_all.where(F.col("_outer") != k), of_all.where(F.col("_outer") == k), label, [id_, label, "_outer"], kind, [parameters])[0]
        return part.withColumnRenamed("_outer", "fold").withColumn("threshold", F.lit(best["threshold"])).withColumn("predicted", F.col("probability") >= best["threshold"])

    scored = reduce(DataFrame.unionByName, _at_once(turn, list(range(outer)), 2))
    drop_cut(rows, *tokens.values())
    return scored
