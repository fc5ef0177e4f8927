"""Plans that must stay as they are: what is read, what is moved."""

from plurifit.operators import balance, fingerprint, sampling
from plurifit.session import scratch_path
from plurifit.sources import sinks, tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark):
    path = scratch_path(spark, "plan")
    df = spark.range(300).selectExpr(
        "id AS row_id", "'a' AS assay", "int(id % 7 = 0) AS hit", "concat(repeat('some words ', 5), id) AS structure"
    )
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_splitting_and_folding_move_no_rows(spark):
    df = stored(spark).select("row_id", "assay", "hit")
    for out in (sampling.train_test_split(df, ["assay"]), sampling.stratified_folds(df, ["assay"]), sampling.repeated_holdout(df, ["assay"], [1, 2])):
        text = plan(out)
        assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text
        assert "structure" not in text


def test_encoding_moves_no_rows(spark):
    text = plan(fingerprint.fingerprints(stored(spark).select("row_id", "structure")))
    assert "Exchange" not in text and text.count("FileScan") == 1 and "hit" not in text


def test_one_family_reads_one_partition(spark):
    path = scratch_path(spark, "fp")
    sinks.write_fingerprints(fingerprint.fingerprints(stored(spark), ["MACCS", "Pattern"]), path)
    text = plan(tables.fingerprints(spark, path, "Pattern").select("row_id"))
    assert "PartitionFilters: [isnotnull(fp" in text and "bits" not in text.split("ReadSchema")[1]


def test_balancing_sends_no_draws_or_vectors_to_the_driver(spark):
    """Whatever grows with the data is joined by shuffles; run first, as small results turn joins into broadcasts while they run."""
    df = spark.range(400).selectExpr("'a' AS assay", "id AS row_id", "int(id % 9 = 0) AS hit", "array(int(id % 5), int(5 + id % 7), int(12 + id % 11)) AS bits")
    made = balance.synthetic_rows(df, ["assay"], width=24)
    assert len(made.collect()) == 310
    sent, depth = [], None
    for line in plan(made).split("+- == Initial Plan ==")[0].split("== Initial Plan ==")[0].splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        depth = at if depth is None and "BroadcastExchange" in line else depth
        if depth is not None:
            sent.append(line)
    assert not [line for line in sent if any(f"{c}#" in line for c in ("draw", "bits", "words", "neighbours"))]
