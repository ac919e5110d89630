"""Features in long form (entity, feature, value): vocabulary, scaling, vectors, chi-squared selection."""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_order

from ..functions.parsing import author_org, log1
from ..operators.reviews import review_features


def _members(name: str, values: Column) -> Column:
    """One feature per distinct member of an array."""
    made = F.transform(F.array_distinct(values), lambda x: F.struct(F.concat(F.lit(name + "_"), x).alias("feature"), F.lit(1.0).alias("value")))
    return F.coalesce(made, F.expr("cast(array() as array<struct<feature:string,value:double>>)"))


def to_long(df: DataFrame, entity: str, numbers: dict[str, Column], categories: dict[str, Column] | None = None, sets: dict[str, Column] | None = None) -> DataFrame:
    """``entity, feature, value``: numbers as they are, categories as ``name=value`` and set members as ``name_member`` with 1; nulls are left out."""
    parts = [F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in numbers.items()])] if numbers else []
    if categories:
        parts.append(F.array(*[F.struct(F.concat(F.lit(n + "="), c.cast("string")).alias("feature"), F.when(c.isNotNull(), F.lit(1.0)).alias("value")) for n, c in categories.items()]))
    for n, c in (sets or {}).items():
        parts.append(_members(n, c))
    return df.select(entity, F.explode(F.concat(*parts)).alias("f")).select(entity, "f.feature", "f.value").filter("feature is not null and value is not null")


METRICS = ("cc", "changes", "complexity", "lloc", "nodes")
COUNTS = ("new_functions", "new_classes")


def commit_features(commits: DataFrame, files: bool = True, committer: bool = True, order: bool = True) -> DataFrame:
    """The features of ordered commits: author, organisation, committer or "same", orders, files, size of the change, blueprint and cherry marks.

    Columns that ``commits`` lacks give no features.
    """
    have = set(commits.columns)

    def col(name: str, made: Column) -> dict[str, Column]:
        return {name: made} if name in have else {}

    numbers = {**col("author_order", F.log("author_order")), **col("loc_add", log1(F.col("loc_add"))), **col("loc_change", log1(F.col("loc_change")))}
    if order and "order" in have:
        numbers["log_order"] = F.log("order")
    if files and order and "file_order" in have:
        numbers["log_min_file_order"] = F.log(F.array_min(F.map_values("file_order")))
        numbers["log_max_file_order"] = F.log(F.array_max(F.map_values("file_order")))
    if "bugs" in have:
        numbers["bugs"] = F.greatest(F.size("bugs"), F.lit(0))
    for mark in ("blueprint", "cherry_picked_from", "cherry_picked_to"):
        if mark in have:
            numbers[mark] = F.col(mark).isNotNull().cast("int")
    categories = {**col("author", F.col("author")), **({"author_org": author_org(F.col("author"))} if "author" in have else {})}
    if committer and {"author", "committer"} <= have:
        categories["committer"] = F.when(F.col("author") == F.col("committer"), "same").otherwise(F.col("committer"))
    return to_long(commits, "cid", numbers, categories, {"includes_file": F.col("files")} if files and "files" in have else None)


def metric_features(files: DataFrame, cid: str = "cid", path: str = "path", tests: bool = True) -> DataFrame:
    """Code metrics by file as features named ``path_metric``; sizes are logarithmic, counts are not."""
    kept = files if tests else files.filter(~F.col(path).contains("test"))
    have = [m for m in (*METRICS, *COUNTS) if m in files.columns]
    cells = F.array(*[F.struct(F.concat(F.col(path), F.lit(f"_{m}")).alias("feature"), (log1(F.col(m)) if m in METRICS else F.col(m).cast("double")).alias("value")) for m in have])
    return kept.select(cid, F.explode(cells).alias("f")).select(cid, "f.feature", "f.value").filter("value is not null")


def review_long(commits: DataFrame, labels: str = "labels", messages: str = "messages") -> DataFrame:
    """What reviews tell, in long form: marks, revisions, who approved, sum of votes and each reviewer's vote."""
    code = F.try_element_at(labels, F.lit("Code-Review"))
    seen = review_features(F.col(labels), F.col(messages))
    base = to_long(commits, "cid", {"review_has_data": seen["has_data"].cast("int"), "review_revision": seen["revision"], "review_votes": F.when(seen["has_data"], seen["votes"])}, {"review_approved_code": seen["approved_code"], "review_approved_workflow": seen["approved_workflow"]})
    votes = commits.select("cid", F.explode(F.filter(code["all"], lambda v: v.isNotNull() & v["name"].isNotNull())).alias("v"))
    return base.unionByName(votes.groupBy("cid", F.concat(F.lit("reviewer_"), "v.name").alias("feature")).agg(F.max("v.value").cast("double").alias("value")).filter("value is not null"))


def fit(long: DataFrame, entities: int | None = None, entity: str = "cid") -> DataFrame:
    """``feature, index, lo, hi``: the vocabulary in alphabetical order with the range of each feature.

    Entities without a feature have 0 there, which counts for the range.
    """
    n = F.lit(entities) if entities is not None else None
    stats = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct(entity).alias("n"))
    if n is None:
        total = long.agg(F.count_distinct(entity).alias("entities"))
        stats = stats.crossJoin(F.broadcast(total))
    else:
        stats = stats.withColumn("entities", n)
    sparse = F.col("n") < F.col("entities")
    ranged = stats.select("feature", F.when(sparse, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(sparse, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    return dense_order(ranged, ["feature"], "index").withColumn("index", (F.col("index") - 1).cast("int"))


def transform(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """``entity, index, value`` scaled by the fitted ranges; unseen features are dropped, values are not clipped, a constant feature keeps its distance to the constant."""
    span = F.col("hi") - F.col("lo")
    return long.join(fitted, "feature").withColumn("value", (F.col("value") - F.col("lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span)).drop("feature", "lo", "hi")


def to_vectors(scaled: DataFrame, size: int, entity: str = "cid") -> DataFrame:
    """``entity, features``: sparse vectors; an entity's own features bound the row."""
    make = F.udf(lambda xs: SparseVector(size, sorted((x["index"], x["value"]) for x in xs)), VectorUDT())
    return scaled.groupBy(entity).agg(make(F.collect_list(F.struct("index", "value"))).alias("features"))


def chi2(long: DataFrame, labels: DataFrame, entity: str = "cid", label: str = "label") -> DataFrame:
    """``feature, chi2``: the statistic of summed non-negative values by class against what class sizes expect."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = sizes.select(label, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    observed = long.join(labels, entity).groupBy("feature", label).agg(F.sum("value").alias("o"))
    totals = observed.groupBy("feature").agg(F.sum("o").alias("total"))
    cells = totals.crossJoin(F.broadcast(share)).join(observed, ["feature", label], "left").withColumn("o", F.coalesce("o", F.lit(0.0))).withColumn("e", F.col("total") * F.col("p"))
    return cells.groupBy("feature").agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("e"))).alias("chi2"))


def select_best(scores: DataFrame, k: int, score: str = "chi2") -> DataFrame:
    """The k features with the greatest score, ties by name."""
    return scores.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "feature").limit(k)
