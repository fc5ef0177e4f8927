"""Scoring new items against a list of saved models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fingerprint import WIDTHS, fingerprint
from ..operators.prepare import resolve, usable_requests
from ..operators.trees import scored_by
from ..sources.registry import load_model


def plan_requests(request: DataFrame, registry: DataFrame, encoded: DataFrame, keep_all: bool = False):
    """Rows to score, in request order, and the full list with reasons for skipping.

    With ``keep_all`` false only the last usable row of an assay is left: the
    earlier ones would be overwritten, so they are not scored at all.
    """
    marked = usable_requests(request, registry, encoded)
    usable = resolve(marked.filter("usable").drop("reason", "usable"), registry)
    if not keep_all:
        last = F.max(F.struct("request_pos", "Model", "MF", "kind", "path")).alias("r")
        usable = usable.groupBy("assay_name").agg(last).select("assay_name", "r.*")
    return usable.orderBy("request_pos").collect(), marked  # one row per model asked for


def score_long(features: Mapping[str, DataFrame], rows) -> DataFrame | None:
    """``(row_id, assay, request_pos, score, prediction)`` for every request row."""
    out = None
    for r in rows:
        frame = features[r["MF"]]
        fitted = load_model(frame.sparkSession, r["kind"], r["path"], WIDTHS[r["MF"]])
        one = fitted.score(frame).select(
            "row_id", F.lit(r["assay_name"]).alias("assay"), F.lit(r["request_pos"]).alias("request_pos"),
            "score", "prediction",
        )
        out = one if out is None else out.unionByName(one)
    return out


def score_wide(compounds: DataFrame, request: DataFrame, registry: DataFrame, min_length: int = 30) -> DataFrame:
    """``(row_id, structure, one column per assay)`` for every item that could be encoded.

    The models of a family are packed into arrays and applied in one pass, so the
    plan grows neither with their depth nor with their number; nothing is pivoted
    and only the families are joined.  Models that cannot be packed (a tree too
    large to send, an estimator of one's own) follow one after the other.
    """
    spark = compounds.sparkSession
    encoded = spark.createDataFrame([(f,) for f in WIDTHS], "fp string")
    rows, _ = plan_requests(request, registry, encoded)
    wide = None
    for family in sorted({r["MF"] for r in rows}):
        frame = fingerprint(compounds, family, min_length).select("row_id", "bits")
        mine = [r for r in rows if r["MF"] == family]
        loaded = [(r["assay_name"], load_model(spark, r["kind"], r["path"], WIDTHS[family])) for r in mine]
        forms = [(name, fitted, fitted.packed()) for name, fitted in loaded]
        for name, fitted, form in forms:
            if form is None:
                frame = fitted.score(frame).withColumnRenamed("prediction", name).drop("score")
        together = [(name, form) for name, _, form in forms if form is not None]
        if together:
            frame = scored_by(frame, [form for _, form in together])
            frame = frame.withColumns({name: F.get("_scores", F.lit(i))["prediction"] for i, (name, _) in enumerate(together)}).drop("_scores")
        frame = frame.drop("bits")
        wide = frame if wide is None else wide.join(frame, "row_id", "full")
    if wide is None:
        return compounds.select("row_id", "structure").limit(0)
    names = [r["assay_name"] for r in rows]
    return compounds.select("row_id", "structure").join(wide, "row_id").select("row_id", "structure", *names)
