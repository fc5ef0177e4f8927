"""Preparation, gates, scalars and grids."""

import pytest
from pyspark.sql import functions as F

from plurifit.functions import scalars
from plurifit.operators import fingerprint, grid, prepare, ranks, sampling
from plurifit.schema import require_columns
from plurifit.session import scratch_path
from plurifit.sources import sinks, tables


def hits(spark, n, positives):
    return spark.range(n).selectExpr("id AS row_id", "'a' AS assay", f"int(id < {positives}) AS hit")


def test_missing_column_is_named(spark):
    with pytest.raises(KeyError, match="structure"):
        prepare.require(spark.range(1), "structure")
    with pytest.raises(KeyError, match="Model"):
        tables.request(spark.createDataFrame([("a", "x")], "assay_name string, MF string"))
    assert require_columns(spark.range(1), ["id"]).columns == ["id"]


def test_assay_number_out_of_range(spark):
    wide = spark.createDataFrame([(1, "s", 1.0)], "row_id long, structure string, a double")
    with pytest.raises(IndexError):
        prepare.assay_by_number(wide, 2)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "row_id long, hit double")
    assert [r.row_id for r in prepare.labelled(df).collect()] == [1]


@pytest.mark.parametrize("positives, open_, reason", [(7, False, "too few minority rows"), (8, True, "ok"), (0, False, "one class")])
def test_gate(spark, positives, open_, reason):
    folded = sampling.stratified_folds(hits(spark, 60, positives), ["assay"])
    row = prepare.gate(folded, ["assay"]).first()
    assert (row["open"], row["reason"]) == (open_, reason)


def test_no_reject_table_means_no_rejects(spark):
    assert tables.rejects(spark, scratch_path(spark, "absent"), "MACCS").count() == 0
    empty = scratch_path(spark, "empty")
    sinks.write_rejects(tables.rejects(spark, scratch_path(spark, "absent")), empty)
    assert tables.rejects(spark, empty).count() == 0


def test_main_fragment_prefers_the_first_of_equal_parts(spark):
    df = spark.createDataFrame([("ab.cde.fgh.i",)], "s string")
    assert df.select(prepare.main_fragment(F.col("s"))).first()[0] == "cde"


def test_dense_ids_with_gaps_and_outliers(spark):
    ids = [5, 7, 1000, 2**60, 2**60 + 1, -3]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = {r.row_id: r.row_no for r in ranks.dense_rank_ids(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_time_seed(spark):
    df = spark.createDataFrame([("10-59-20",), ("25-00-00",), ("abc",)], "t string")
    assert [r[0] for r in df.select(scalars.time_seed(F.col("t"), strict=False)).collect()] == [2208988800 - 39560, None, None]
    with pytest.raises(Exception, match="HH-MM-SS"):
        df.select(scalars.time_seed(F.col("t"))).collect()


def test_linspace_and_argmax(spark):
    row = spark.range(1).select(
        scalars.linspace(F.lit(0), F.lit(3), 10).alias("l"), scalars.argmax(F.array(F.lit(1), F.lit(5), F.lit(5))).alias("a")
    ).first()
    assert row.l[0] == 0 and row.l[-1] == 3 and len(row.l) == 10 and row.a == 1


def test_grid_errors_and_order():
    with pytest.raises(TypeError):
        grid.expand([1, 2])
    with pytest.raises(TypeError, match="'a'"):
        grid.expand({"a": 3})
    assert grid.expand({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    sizes = {m: len(grid.expand(g)) for m, g in grid.GRIDS.items()}
    assert sizes == {"dt": 108, "rf": 104, "gbt": 100, "xgb": 120, "logistic": 100}
    assert len(grid.distinct_candidates("dt", grid.expand(grid.GRIDS["dt"]))) == 60
    assert len(grid.distinct_candidates("logistic", grid.expand(grid.GRIDS["logistic"]))) == 50


def test_unknown_family(spark):
    with pytest.raises(ValueError, match="unknown"):
        fingerprint.fingerprint(spark.createDataFrame([], "row_id long, structure string"), "ECFP")


def test_texts_that_cannot_be_encoded(spark):
    items = spark.createDataFrame([(1, None), (2, " " * 40), (3, "short"), (4, "x" * 40)], "row_id long, structure string")
    bad = {(r.row_id, r.reason) for r in fingerprint.rejects(items, ["MACCS"]).collect()}
    assert bad == {(1, "missing"), (2, "blank"), (3, "too short")}
    assert [r.row_id for r in fingerprint.fingerprint(items, "Pattern").collect()] == [4]


def test_one_pass_equals_single_families(spark):
    items = spark.createDataFrame(
        [(i, " ".join(["Word%d" % (i * j % 7) for j in range(i + 8)]) + ".") for i in range(6)], "row_id long, structure string"
    )
    together = {(r.row_id, r.fp): r.bits for r in fingerprint.fingerprints(items).collect()}
    for family, width in fingerprint.WIDTHS.items():
        for r in fingerprint.fingerprint(items, family).collect():
            assert together[(r.row_id, family)] == r.bits == sorted(set(r.bits)) and max(r.bits) < width


def test_columns_and_bits_round_trip(spark):
    df = spark.createDataFrame([(1, [0, 2]), (2, [])], "row_id long, bits array<int>")
    back = tables.columns_to_bits(prepare.bits_to_columns(df, "MACCS", 4), "MACCS")
    assert {r.row_id: r.bits for r in back.collect()} == {1: [0, 2], 2: []}


def test_resume_leaves_only_what_is_missing(spark):
    path = scratch_path(spark, "results")
    assert sinks.stored_results(spark, path).count() == 0
    done = spark.createDataFrame([("a", "MACCS", "dt", 0, 0, 1.0, 1.0, 1.0, 1.0, None)],
                                 "assay string, fp string, model string, param_idx int, fold int, precision double, recall double, f1 double, accuracy double, roc_auc double")
    sinks.append_results(done, path)
    every = spark.createDataFrame([("a", "MACCS", "dt", i) for i in range(3)], "assay string, fp string, model string, param_idx int")
    assert sorted(r.param_idx for r in sinks.pending(every, sinks.stored_results(spark, path)).collect()) == [1, 2]


def test_missing_labels_given_as_nan(spark):
    wide = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 0.0)], "row_id long, a double")
    assert {(r.row_id, r.hit) for r in prepare.labelled(prepare.melt(wide, assays=["a"]).filter("hit IS NOT NULL")).collect()} == {(1, 1), (4, 0)}


def test_writing_one_family_keeps_the_others(spark):
    path = scratch_path(spark, "families")
    for family in ("MACCS", "Morgan", "MACCS"):
        sinks.write_fingerprints(spark.createDataFrame([(1, [2, 3], family)], "row_id long, bits array<int>, fp string"), path)
    assert sorted(r.fp for r in spark.read.parquet(path).collect()) == ["MACCS", "Morgan"]
