"""One query per operator, each over the whole of the tables it reads.

Stand-ins: ``documents`` are the compounds (``text`` is the structure),
``labels.quality`` and ``labels.toxic`` two assays that most compounds lack, and
``embeddings`` real-valued features with the task ``label = 0``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import balance, fingerprint, grid, metrics, neighbours, pls, prepare, ranks, sampling, trees
from ..plans import campaign, scoring, search
from ..plans.estimators import fit
from ..session import materialise, scratch_path
from ..sources import registry as models
from ..sources import sinks, tables

ASSAYS = ("quality", "toxic")
RUN_CLOCK = "10-59-20"
REPEATS = tuple(range(20, 30))
BY = ["assay"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# ---------------------------------------------------------------- stand-ins


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    return tables.compounds(tables.spread(tables.table(spark, sf, "documents")), "doc_id", "text")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    joined = docs.join(tables.table(spark, sf, "labels"), "doc_id", "left")
    return tables.assays(joined, "doc_id", "text", ASSAYS)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.melt(tables.table(spark, sf, "labels"), "doc_id", ASSAYS)


def toxic(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).filter("assay = 'toxic'")


def features(spark: SparkSession, sf: str, which: DataFrame, families=("MACCS",)) -> DataFrame:
    return campaign.aligned(compounds(spark, sf), which, families)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with many ties for the metric queries."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    score = (F.col("n_chars") % 37).cast("double") / F.lit(37.0)
    return docs.join(tables.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), "lang", "source", F.col("toxic").alias("y"),
        score.alias("score"), (score >= 0.5).cast("int").alias("prediction"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.lit("label0").alias("assay"), "label",
        (F.col("label") == 0).cast("int").alias("hit"), F.col("embedding").alias("features"),
    )


def six(column: str):
    return F.round(column, 6).alias(column)


def listed(column: str, name: str | None = None):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(name or column)


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with a fold each: one task over all scored rows."""
    keyed = scores(spark, sf).withColumn("assay", F.lit("toxic")).withColumn("hit", F.col("y"))
    return sampling.stratified_folds(keyed, BY)


# ---------------------------------------------------------- sources and sinks


@query
def src_assay_wide(spark, sf):
    return wide(spark, sf)


def _stored_fingerprints(spark, sf, families):
    path = scratch_path(spark, "fp")
    sinks.write_fingerprints(fingerprint.fingerprints(compounds(spark, sf), families), path)
    return path


@query
def src_fingerprint_partition(spark, sf):
    path = _stored_fingerprints(spark, sf, ["MACCS", "Pattern"])
    return tables.fingerprints(spark, path, "Pattern").select("row_id", "fp", listed("bits"))


@query
def src_rejects(spark, sf):
    path = scratch_path(spark, "rejects")
    sinks.write_rejects(fingerprint.rejects(compounds(spark, sf)), path)
    return tables.rejects(spark, path, "Morgan").select("row_id", "fp", "reason")


@query
def src_request(spark, sf):
    return tables.request(_request(spark, sf))


def _request(spark, sf) -> DataFrame:
    """A request made of the sources (as assays) and languages (as families) there are."""
    family = F.when(F.col("lang") == "en", "MACCS").when(F.col("lang") == "de", "Morgan").otherwise(F.upper("lang"))
    return (
        tables.table(spark, sf, "documents")
        .groupBy(F.col("source").alias("assay_name"), F.lit("dt").alias("Model"), family.alias("MF"))
        .agg(F.min("doc_id").alias("request_pos"))
    )


def _registry(spark, sf) -> DataFrame:
    """Models for the (source, language) pairs in which some document is toxic."""
    family = F.when(F.col("lang") == "en", "MACCS").when(F.col("lang") == "de", "Morgan").otherwise(F.upper("lang"))
    known = scores(spark, sf).groupBy(F.col("source").alias("assay"), family.alias("fp")).agg(F.max("y").alias("y"))
    return known.filter("y = 1").select(
        "assay", "fp", F.lit("dt").alias("model"), F.lit("tree").alias("kind"),
        scalars.model_key(F.col("assay"), F.col("fp"), F.lit("dt")).alias("path"),
    )


@query
def snk_fp_roundtrip(spark, sf):
    path = _stored_fingerprints(spark, sf, ["MACCS", "Morgan"])
    both = tables.fingerprints(spark, path, "MACCS").unionByName(tables.fingerprints(spark, path, "Morgan"))
    return both.select("row_id", "fp", listed("bits"))


@query
def snk_rejects_roundtrip(spark, sf):
    path = scratch_path(spark, "rejects")
    sinks.write_rejects(fingerprint.rejects(compounds(spark, sf)), path)
    return tables.rejects(spark, path).select("row_id", "fp", "reason")


@query
def snk_split_roundtrip(spark, sf):
    split = sampling.train_test_split(hits(spark, sf), BY)
    path = scratch_path(spark, "split")
    stamped = (
        split.withColumn("data_name", F.lit("documents")).withColumn("fp", F.lit("MACCS"))
        .withColumn("model", F.lit("dt")).withColumn("run_date", F.lit("20250408")).withColumn("run_time", F.lit(RUN_CLOCK))
    )
    sinks.write_split(stamped, path)
    back = spark.read.parquet(path)
    return back.select("row_id", "hit", *[F.col(c).cast("string").alias(c) for c in sinks.SPLIT_LEVELS])


@query
def snk_results_resume(spark, sf):
    """Stored results of half the candidates, and what a restart has left to do."""
    wanted = scores(spark, sf).select(
        F.col("lang").alias("assay"), F.col("source").alias("fp"), F.lit("dt").alias("model"),
        F.round(F.col("score") * 37).cast("int").alias("param_idx"),
    ).distinct()
    path = scratch_path(spark, "results")
    row = metrics.confusion(scores(spark, sf), ["lang", "source", "score"])
    done = row.filter("score < 0.5").select(
        F.col("lang").alias("assay"), F.col("source").alias("fp"), F.lit("dt").alias("model"),
        F.round(F.col("score") * 37).cast("int").alias("param_idx"), F.lit(0).alias("fold"),
        metrics.precision().alias("precision"), metrics.recall().alias("recall"), metrics.f1().alias("f1"),
        metrics.accuracy().alias("accuracy"), F.lit(None).cast("double").alias("roc_auc"),
    )
    sinks.append_results(done, path)
    return sinks.pending(wanted, sinks.stored_results(spark, path))


@query
def metric_record(spark, sf):
    split = sampling.train_test_split(scores(spark, sf), ["lang"])
    parts = {p: metrics.all_metrics(split.filter(F.col("split") == p), ["lang"]) for p in ("train", "test")}
    path = scratch_path(spark, "metrics")
    sinks.log_metrics(sinks.metric_rows(parts["train"], parts["test"], ["lang"]), path)
    return spark.read.parquet(path).select("lang", "part", "metric", six("value"))


# ------------------------------------------------- projection, filter, predicate


@query
def prj_required(spark, sf):
    return prepare.require(compounds(spark, sf), "structure")


@query
def prj_assay_by_number(spark, sf):
    return prepare.assay_by_number(wide(spark, sf), 2)


@query
def prj_assay_names(spark, sf):
    return prepare.assay_names(wide(spark, sf))


@query
def prj_melt_assays(spark, sf):
    return prepare.melt(wide(spark, sf))


@query
def prj_bit_columns(spark, sf):
    return prepare.bits_to_columns(fingerprint.fingerprint(compounds(spark, sf)), "MACCS", fingerprint.WIDTHS["MACCS"])


@query
def flt_labelled(spark, sf):
    return prepare.labelled(prepare.melt(wide(spark, sf)))


@query
def flt_drop_rejects(spark, sf):
    items = compounds(spark, sf)
    return prepare.drop_rejects(items, fingerprint.rejects(items, ["MACCS"]).drop("fp"))


@query
def flt_parseable(spark, sf):
    text = F.col("structure")
    return compounds(spark, sf).select(
        "row_id", prepare.parseable(text).alias("ok"), prepare.reject_reason(text).alias("reason")
    )


@query
def flt_usable_requests(spark, sf):
    families = spark.createDataFrame([(f,) for f in fingerprint.WIDTHS], "fp string")
    marked = prepare.usable_requests(tables.request(_request(spark, sf)), _registry(spark, sf), families)
    return marked.select("assay_name", "Model", "MF", "request_pos", "usable", "reason")


@query
def flt_gate(spark, sf):
    return prepare.gate(sampling.stratified_folds(hits(spark, sf), BY), BY)


@query
def flt_min_support(spark, sf):
    """Toxicity per source as one assay each; small ones drop out."""
    each = scores(spark, sf).select("row_id", F.col("source").alias("assay"), F.col("y").alias("hit"))
    return prepare.min_support(each, 5).select("row_id", "assay", "hit")


@query
def flt_main_fragment(spark, sf):
    text = F.col("structure")
    return compounds(spark, sf).select(
        "row_id", prepare.main_fragment(text).alias("fragment"), prepare.has_symbol(text, "[0-9]").alias("has_digit")
    )


@query
def flt_dense_index(spark, sf):
    items = compounds(spark, sf)
    kept = prepare.drop_rejects(items, fingerprint.rejects(items, ["MACCS"]).drop("fp"))
    return ranks.dense_rank_ids(kept.select("row_id"))


# ------------------------------------------------------------------------ joins


@query
def join_align_xy(spark, sf):
    known = hits(spark, sf)
    return prepare.align(fingerprint.fingerprint(compounds(spark, sf)), known).select(
        "row_id", "assay", "hit", listed("bits")
    )


@query
def join_request_registry(spark, sf):
    return prepare.resolve(tables.request(_request(spark, sf)), _registry(spark, sf)).select(
        "assay_name", "Model", "MF", "request_pos", "kind", "path"
    )


@query
def join_attach_structure(spark, sf):
    predicted = scores(spark, sf).select("row_id", "prediction")
    return prepare.attach(predicted, compounds(spark, sf))


@query
def join_knn_hamming(spark, sf):
    """Neighbours inside the smaller class of both assays."""
    small = materialise(balance.minority(features(spark, sf, hits(spark, sf)), BY), "minority")
    return neighbours.ranked(neighbours.knn_hamming(small, BY), BY)


@query
def join_knn_euclid(spark, sf):
    """Neighbours among the vectors of the same label, for all of them."""
    return neighbours.ranked(neighbours.knn_euclid(vectors(spark, sf), ["label"]), ["label"])


@query
def join_run_matrix(spark, sf):
    counted = prepare.class_counts(hits(spark, sf), BY)
    return prepare.run_matrix(counted, list(grid.GRIDS), list(fingerprint.WIDTHS), REPEATS)


# ------------------------------------------------------------------ aggregation


@query
def agg_confusion(spark, sf):
    return metrics.confusion(scores(spark, sf), ["lang", "source"])


def _one_metric(name: str, column) -> None:
    def run(spark, sf):
        counted = metrics.confusion(scores(spark, sf), ["lang", "source"])
        return counted.select("lang", "source", F.round(column(), 6).alias(name))

    QUERIES[f"agg_{name}"] = run


for _name, _column in (
    ("precision", metrics.precision), ("recall", metrics.recall), ("f1", metrics.f1), ("accuracy", metrics.accuracy),
):
    _one_metric(_name, _column)


@query
def agg_roc_auc(spark, sf):
    return metrics.roc_auc(scores(spark, sf), ["lang"]).select("lang", "n_pos", "n_neg", six("roc_auc"))


def _fold_summary(spark, sf, how):
    counted = metrics.confusion(fold_scores(spark, sf), ["lang", "fold"])
    per_fold = counted.select(
        "lang", metrics.precision().alias("precision"), metrics.recall().alias("recall"),
        metrics.f1().alias("f1"), metrics.accuracy().alias("accuracy"),
    )
    names = ["precision", "recall", "f1", "accuracy"]
    return metrics.summarise(per_fold, ["lang"], how, names).select("lang", *[six(n) for n in names])


@query
def agg_fold_mean(spark, sf):
    return _fold_summary(spark, sf, "mean")


@query
def agg_fold_median(spark, sf):
    return _fold_summary(spark, sf, "median")


@query
def agg_class_counts(spark, sf):
    return prepare.class_counts(hits(spark, sf), BY)


@query
def agg_reject_count(spark, sf):
    return metrics.reject_counts(fingerprint.rejects(compounds(spark, sf)))


@query
def agg_train_val_metrics(spark, sf):
    """Training and validation means over folds, the language standing in for the candidate."""
    rows = fold_scores(spark, sf)
    training = sampling.training_parts(rows).withColumn("part", F.lit("train")).withColumnRenamed("cv_fold", "fold")
    both = training.unionByName(rows.withColumn("part", F.lit("val")))
    measured = metrics.all_metrics(both, ["lang", "fold", "part"]).withColumnRenamed("lang", "param_idx")
    means = search.train_and_validation_means(measured, [])
    return means.select(
        F.col("param_idx").alias("lang"), *[six(c) for c in means.columns if c != "param_idx"]
    )


def _two_requests(spark, sf) -> DataFrame:
    """Two predictions per document and assay, from two request rows."""
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    rows = F.inline(F.expr(
        "array(named_struct('assay', 'quality', 'request_pos', 0L, 'prediction', int(n_chars % 2)),"
        " named_struct('assay', 'quality', 'request_pos', 2L, 'prediction', int(n_chars % 3 = 0)),"
        " named_struct('assay', 'toxic', 'request_pos', 1L, 'prediction', int(n_chars % 5 = 0)),"
        " named_struct('assay', 'toxic', 'request_pos', 3L, 'prediction', int(n_chars % 7 = 0)))"
    ))
    return docs.select("row_id", rows)


@query
def agg_last_wins(spark, sf):
    return metrics.last_wins(_two_requests(spark, sf))


@query
def pred_wide(spark, sf):
    last = metrics.last_wins(_two_requests(spark, sf))
    path = sinks.write_predictions(
        sinks.wide_predictions(last, compounds(spark, sf), ASSAYS), scratch_path(spark, "predictions"), "20250408", RUN_CLOCK
    )
    return spark.read.parquet(path)


# ------------------------------------------------------------ selection and sets


def _candidate_results(spark, sf) -> DataFrame:
    """F1 per language, source and fold; the number of the source is the candidate."""
    counted = metrics.confusion(fold_scores(spark, sf), ["lang", "source", "fold"])
    return counted.select(
        "lang", F.substring("source", 4, 10).cast("int").alias("param_idx"), "fold", metrics.f1().alias("f1")
    )


@query
def top_best_candidate(spark, sf):
    return metrics.best_candidate(_candidate_results(spark, sf), ["lang"]).select("lang", "param_idx", six("best_score"))


@query
def set_union_synthetic(spark, sf):
    return balance.balanced(materialise(features(spark, sf, hits(spark, sf)), "x"), BY).select(
        "assay", "row_id", "hit", "is_synthetic", listed("bits")
    )


@query
def set_distinct_candidates(spark, sf):
    """Linear candidates with the strength of their penalty on each assay, solvers dropped."""
    sizes = hits(spark, sf).groupBy("assay").agg(F.count(F.lit(1)).alias("n_train"))
    every = sizes.select("assay", "n_train", F.inline(grid.grid_column(grid.GRIDS["logistic"])))
    strength = 1.0 / (F.get_json_object("params", "$.C").cast("double") * F.col("n_train"))
    mapped = every.select(
        "assay", "param_idx", F.get_json_object("params", "$.penalty").alias("penalty"),
        F.round(strength, 9).alias("reg_param"),
    )
    return grid.collapse(mapped, ["assay", "penalty", "reg_param"])


@query
def grd_expand(spark, sf):
    """The tree grid beside the size of every assay, with the rows a split really needs."""
    sizes = hits(spark, sf).groupBy("assay").agg(F.count(F.lit(1)).alias("n_rows"))
    every = sizes.select("assay", "n_rows", F.inline(grid.grid_column(grid.GRIDS["dt"])))

    def setting(name, kind="int"):
        return F.get_json_object("params", f"$.{name}").cast(kind).alias(name)

    return every.select(
        "assay", "n_rows", "param_idx", setting("criterion", "string"), setting("max_depth"),
        setting("min_samples_leaf"), setting("min_samples_split"),
    )


# ---------------------------------------------------------------- scalar functions


@query
def sc_model_key(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", scalars.model_key(F.col("source"), F.col("lang"), F.lit("dt")).alias("model_key"))


@query
def sc_time_seed(spark, sf):
    clock = F.date_format("ts", "HH-mm-ss")
    events = tables.table(spark, sf, "events").select("event_id", clock.alias("clock"))
    return events.select(
        "event_id", "clock", scalars.time_seed(F.col("clock")).alias("seed"),
        scalars.time_seed(F.concat("clock", F.lit("x")), strict=False).alias("bad_seed"),
    )


@query
def sc_run_date(spark, sf):
    orders = tables.table(spark, sf, "orders")
    return orders.select(
        "o_orderkey", scalars.run_date(F.col("o_orderdate")).alias("stamp"),
        scalars.run_date(F.col("o_orderdate"), dashed=True).alias("dashed"),
    )


@query
def sc_linspace(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(scalars.linspace(F.lit(0), F.col("n_chars"), 10)).alias("pos", "value")).select(
        "doc_id", "pos", six("value")
    )


@query
def sc_argmax(spark, sf):
    return tables.table(spark, sf, "embeddings").select("vec_id", scalars.argmax(F.col("embedding")).cast("bigint").alias("place"))


@query
def sc_one_hot(spark, sf):
    return tables.table(spark, sf, "embeddings").select(
        "vec_id", listed_column(scalars.one_hot(F.col("label"), range(10))).alias("one_hot")
    )


def listed_column(column):
    return F.array_join(column.cast("array<string>"), ",")


@query
def sc_results_json(spark, sf):
    row = metrics.confusion(scores(spark, sf), ["lang", "source"])
    text = row.select(scalars.results_json("lang", "source", "n_tp", "n_fp", "n_fn", "n_tn").alias("j"))
    parsed = F.from_json("j", "lang string, source string, n_tp bigint, n_fp bigint, n_fn bigint, n_tn bigint")
    return text.select(parsed.alias("r")).select("r.*")


# ------------------------------------------------------------ sampling and balancing


@query
def smp_train_test(spark, sf):
    return sampling.train_test_split(hits(spark, sf), BY).select("row_id", "assay", "split")


@query
def smp_time_seeded(spark, sf):
    seed = scalars.time_seed(F.lit(RUN_CLOCK))
    return sampling.train_test_split(hits(spark, sf), BY, seed).select("row_id", "assay", "split")


@query
def smp_stratified_kfold(spark, sf):
    return sampling.stratified_folds(hits(spark, sf), BY).select("row_id", "assay", "hit", "fold")


@query
def smp_kfold_ordered(spark, sf):
    return sampling.stratified_folds(hits(spark, sf), BY, shuffle=False).select("row_id", "assay", "hit", "fold")


@query
def smp_stratified_split(spark, sf):
    return sampling.stratified_split(hits(spark, sf), BY).select("row_id", "assay", "hit", "split")


@query
def smp_repeated_holdout(spark, sf):
    return sampling.repeated_holdout(hits(spark, sf), BY, REPEATS).select("row_id", "assay", "seed", "split")


@query
def smp_smote_bits(spark, sf):
    made = balance.synthetic_rows(materialise(features(spark, sf, hits(spark, sf)), "x"), BY)
    return made.select("assay", "draw", "base_id", "neighbour_id", "hit", listed("bits"))


@query
def smp_smote_interpolate(spark, sf):
    made = balance.synthetic_rows(vectors(spark, sf).drop("label"), BY, mode="interpolate")
    value = F.posexplode("features").alias("pos", "value")
    return made.select("draw", "base_id", "neighbour_id", six("gap"), value).select(
        "draw", "base_id", "neighbour_id", "gap", "pos", F.round("value", 5).alias("value")
    )


# -------------------------------------------------------------------- fingerprints


def _family(name: str, family: str) -> None:
    def run(spark, sf):
        return fingerprint.fingerprint(compounds(spark, sf), family).select("row_id", listed("bits"))

    QUERIES[name] = run


for _name, _column in (
    ("fp_dictionary", "MACCS"), ("fp_neighbourhood", "Morgan"), ("fp_paths", "RDKit"),
    ("fp_layered", "Layered"), ("fp_patterns", "Pattern"),
):
    _family(_name, _column)


@query
def fp_all_families(spark, sf):
    every = fingerprint.fingerprints(compounds(spark, sf))
    return every.select(
        "row_id", "fp", F.size("bits").alias("n_bits"),
        F.aggregate("bits", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("bit_sum"),
    )


@query
def fp_pack(spark, sf):
    words = fingerprint.packed(F.col("bits"), fingerprint.WIDTHS["MACCS"])
    return fingerprint.fingerprint(compounds(spark, sf)).select("row_id", F.posexplode(words).alias("place", "word"))


# --------------------------------------------------------------- models and search


def _scan(criterion):
    def run(spark, sf):
        scanned = trees.split_scan(features(spark, sf, hits(spark, sf)), BY, criterion)
        return scanned.select("assay", "bit", "s", "s1", "n", "n1", six("gain"))

    QUERIES[f"cl_split_scan_{criterion}"] = run


_scan("gini")
_scan("entropy")


@query
def cl_tree_levelwise(spark, sf):
    """Trees of two levels for both assays, grown together."""
    rows = features(spark, sf, hits(spark, sf)).withColumn("train", F.lit(True))
    rules = trees.growth_rules([{"criterion": "gini"}])
    return trees.grow(rows, BY, rules, 2).select("assay", "depth", "node", "n", "n1", "bit")


def _folded(spark, sf, **how):
    """All labelled rows of both assays in five stratified folds."""
    aligned = materialise(features(spark, sf, hits(spark, sf)), "aligned")  # read several times to find the cuts
    return materialise(sampling.stratified_folds(aligned, ["assay", "fp"], **how), "train")


@query
def cl_decision_tree(spark, sf):
    """The full tree grid for both assays: 108 candidates in five balanced folds, grown together."""
    return search.cross_validate(_folded(spark, sf), ["assay", "fp"], [], "dt", grid.expand(grid.GRIDS["dt"]))


def _cv(model: str, whole: dict):
    """Search over a whole grid in five folds for both assays."""
    def run(spark, sf):
        both = [{"assay": assay, "fp": "MACCS"} for assay in ASSAYS]
        return search.cross_validate(_folded(spark, sf), ["assay", "fp"], both, model, grid.expand(whole))

    return run


QUERIES["cl_logistic"] = _cv("logistic", grid.GRIDS["logistic"])
QUERIES["cl_random_forest"] = _cv("rf", grid.GRIDS["rf"])
QUERIES["cl_gbt"] = _cv("gbt", grid.GRIDS["gbt"])
QUERIES["cl_regularised_boost"] = _cv("xgb", grid.GRIDS["xgb"])
# there is no grid for this family: one component, and the default of two
QUERIES["cl_pls_da"] = _cv("pls", {"n_components": [1, 2]})


@query
def cl_pls_gram(spark, sf):
    rows = features(spark, sf, toxic(spark, sf))
    return pls.gram_entries(rows, fingerprint.WIDTHS["MACCS"])


@query
def cv_grid_search(spark, sf):
    """Search of the full tree grid for both assays at once; results per candidate and fold."""
    return search.cross_validate(_folded(spark, sf), ["assay", "fp"], [], "dt", grid.expand(grid.GRIDS["dt"]))


@query
def cv_plain(spark, sf):
    """The full tree grid for both assays without resampling, unshuffled folds, training and validation means."""
    found = search.cross_validate(
        _folded(spark, sf, shuffle=False), ["assay", "fp"], [], "dt", grid.expand(grid.GRIDS["dt"]), resample=None, with_train=True,
    )
    return search.train_and_validation_means(found, ["assay", "fp"])


def _split_features(spark, sf):
    """(assay, training rows, test rows) of both assays."""
    data = materialise(sampling.train_test_split(features(spark, sf, hits(spark, sf)), ["assay", "fp"]), "split")
    for assay in ASSAYS:
        mine = data.filter(F.col("assay") == assay)
        yield assay, mine.filter("split = 'train'"), mine.filter("split = 'test'")


TREE = {"criterion": "gini", "max_depth": 3}


@query
def fit_final_and_test(spark, sf):
    out = []
    for assay, train, test in _split_features(spark, sf):
        _, tested = campaign.fit_final(train, test, "dt", TREE, fingerprint.WIDTHS["MACCS"])
        out.append((assay, *(tested[m] for m in metrics.METRICS)))
    made = spark.createDataFrame(out, "assay string, " + ", ".join(f"{m} double" for m in metrics.METRICS))
    return made.select("assay", *[six(m) for m in metrics.METRICS])


def _fitted_scores(spark, sf):
    scored = [fit(train, "dt", TREE, fingerprint.WIDTHS["MACCS"]).score(test) for _, train, test in _split_features(spark, sf)]
    return reduce(DataFrame.unionByName, scored)


@query
def pred_class(spark, sf):
    return _fitted_scores(spark, sf).select("assay", "row_id", "prediction")


@query
def pred_probability(spark, sf):
    return _fitted_scores(spark, sf).select("assay", "row_id", F.round("score", 6).alias("probability"))


def _saved(spark, sf, root):
    """A tree and a linear model per assay, saved; returns the registry."""
    data = materialise(features(spark, sf, hits(spark, sf)), "features")
    width = fingerprint.WIDTHS["MACCS"]
    linear = {"C": 1, "penalty": "l2"}
    for assay in ASSAYS:
        mine = data.filter(F.col("assay") == assay)
        models.save_model(spark, fit(mine, "dt", TREE, width), root, assay, "MACCS", "dt")
    models.save_model(spark, fit(data.filter("assay = 'toxic'"), "logistic", linear, width), root, "toxic", "MACCS", "logistic")
    return models.registry(spark, root)


@query
def model_roundtrip(spark, sf):
    """Saved models, loaded and applied to all labelled documents."""
    known = _saved(spark, sf, scratch_path(spark, "models"))
    encoded = materialise(features(spark, sf, toxic(spark, sf)), "features")
    out = None
    for r in known.orderBy("assay", "model").collect():  # three saved models
        loaded = models.load_model(spark, r["kind"], r["path"], fingerprint.WIDTHS["MACCS"])
        one = loaded.score(encoded).select("row_id", F.lit(r["assay"]).alias("assay"), F.lit(r["model"]).alias("model"), "prediction")
        out = one if out is None else out.unionByName(one)
    return out


@query
def pred_batch(spark, sf):
    """A request of four rows (one of them for a model that does not exist) over all documents."""
    known = _saved(spark, sf, scratch_path(spark, "models"))
    asked = spark.createDataFrame(
        [("quality", "dt", "MACCS", 0), ("toxic", "dt", "MACCS", 1), ("toxic", "logistic", "MACCS", 2), ("toxic", "rf", "MACCS", 3)],
        "assay_name string, Model string, MF string, request_pos bigint",
    )
    return scoring.score_wide(compounds(spark, sf), tables.request(asked), known)


@query
def flagship(spark, sf):
    """Best one-bit rule per assay, found on the training rows and tested on the hold-out."""
    data = materialise(features(spark, sf, hits(spark, sf)), "aligned")
    split = sampling.train_test_split(data, BY)
    best = trees.best_split(trees.split_scan(split.filter("split = 'train'"), BY), BY)
    rule = F.broadcast(best.selectExpr("assay", "bit", "s1 / s AS p_set", "(n1 - s1) / (n - s) AS p_unset"))  # one row per assay
    scored = split.filter("split = 'test'").join(rule, "assay").withColumn(
        "score", F.expr("IF(array_contains(bits, bit), p_set, p_unset)")
    ).withColumn("prediction", F.expr("int(score >= greatest(p_set, p_unset))")).withColumnRenamed("hit", "y")
    tested = metrics.all_metrics(scored, ["assay", "bit"])
    return tested.select("assay", "bit", *[six(m) for m in metrics.METRICS])


@query
def campaign_run(spark, sf):
    """A campaign per assay over the full tree grid."""
    return campaign.run(compounds(spark, sf), hits(spark, sf), models={"dt": grid.GRIDS["dt"]})


QUERIES["campaign"] = QUERIES.pop("campaign_run")
