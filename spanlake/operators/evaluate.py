"""Span evaluation: gold rows joined with predictions, metrics of each row in one select, one aggregate per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S

IOU_AT, CONTAINED_AT, COVERED_AT = (0.3, 0.5, 0.7), (0.5, 0.8, 1.0), (0.5, 0.8, 1.0)


def tag(threshold: float) -> str:
    return f"{round(threshold * 100):d}"


def last_predictions(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One prediction per run and key: the last by (created_at, prediction_id). The query may sit in `question`; null ids read as "" and -1."""
    keyed = predictions.withColumns({"query": F.coalesce("query", "question", F.lit("")), "paper_id": F.coalesce("paper_id", F.lit("")), "chunk_index": F.coalesce("chunk_index", F.lit(-1))})
    keys = [*(by or []), "query", "paper_id", "chunk_index"]
    others = [c for c in ("prediction_id", "pred_spans", "predicted_texts", "latency_s", "error") if c in predictions.columns]
    best = F.max_by(F.struct(*others), F.struct("created_at", "prediction_id"))
    return keyed.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}") for c in others])


def for_every_run(rows: DataFrame, predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """rows(query, paper_id, chunk_index, ...) once for every run_name of runs, with the last prediction of that run for its key (null without one)."""
    keys = ["query", "paper_id", "chunk_index"]
    last = last_predictions(predictions, ["run_name"])
    others = [c for c in last.columns if c not in (*keys, "run_name")]
    by_key = last.groupBy(*keys).agg(F.collect_list(F.struct("run_name", *others)).alias("_p"))  # one of each run
    names = runs.agg(F.array_sort(F.collect_set("run_name")).alias("_r"))  # one row
    each = rows.join(by_key, keys, "left").crossJoin(F.broadcast(names)).withColumn("run_name", F.explode("_r"))
    own = F.try_element_at(F.filter("_p", lambda x: x["run_name"] == F.col("run_name")), F.lit(1))
    return each.withColumn("_o", own).select("run_name", *rows.columns, *[F.col(f"_o.{c}") for c in others])


def evaluated(gold: DataFrame, predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """Every gold row for every run, with its prediction if there is one, and its counts. The predictions of a key are gathered over the runs first,
    so that each text meets them in one shuffle and is repeated per run only within its task.

    A missing prediction is an empty one with latency 0. gold: span_row_id, query, paper_id, chunk_index, chunk, is_relevant, gold_spans.
    """
    rows = gold.withColumns({"query": F.coalesce("query", F.lit("")), "paper_id": F.coalesce("paper_id", F.lit("")), "chunk_index": F.coalesce("chunk_index", F.lit(-1)), "chunk": F.coalesce("chunk", F.lit(""))})
    joined = for_every_run(rows, predictions, runs)
    none = F.array().cast(S.SPANS)
    joined = joined.withColumns({"pred": S.predicted_spans(F.col("pred_spans"), F.col("predicted_texts"), F.col("chunk")), "gold": F.coalesce(F.col("gold_spans"), none).cast(S.SPANS)})
    joined = joined.withColumns({"pw": S.word_set(F.col("chunk"), F.col("pred")), "gw": S.word_set(F.col("chunk"), F.col("gold"))})
    pred, g = F.col("pred"), F.col("gold")
    out: dict[str, Column] = {
        "pred_count": F.size(pred),
        "gold_count": F.size(g),
        "word_tp": F.size(F.array_intersect("pw", "gw")),
        "overlap_hits": S.touched(g, pred),
        "latency": F.coalesce("latency_s", F.lit(0.0)),
        "failed": F.coalesce(F.col("error") != "", F.lit(False)),
    }
    out |= {"word_fp": F.size("pw") - F.size(F.array_intersect("pw", "gw")), "word_fn": F.size("gw") - F.size(F.array_intersect("pw", "gw"))}
    out |= {f"iou_tp_{tag(t)}": S.iou_matches(pred, g, t) for t in IOU_AT}
    out |= {f"cont_pred_{tag(t)}": S.contained(pred, g, t, True) for t in CONTAINED_AT}
    out |= {f"cont_gold_{tag(t)}": S.contained(g, pred, t, False) for t in CONTAINED_AT}
    out |= {f"cov_{tag(t)}": S.covered(g, pred, t) for t in COVERED_AT}
    return joined.select("run_name", "span_row_id", "is_relevant", *[c.alias(n) for n, c in out.items()])


def _prf(tp: Column, n_pred: Column, n_gold: Column) -> tuple[Column, Column, Column]:
    p, r = S.safe_div(tp, n_pred), S.safe_div(tp, n_gold)
    return p, r, S.f1(p, r)


def with_scores(rows: DataFrame) -> DataFrame:
    """Row F1s: words (both sides empty: 0), IoU and containment (both sides empty: 1), coverage (no gold: 1)."""
    c = F.col
    p, r, f = _prf(c("word_tp"), c("word_tp") + c("word_fp"), c("word_tp") + c("word_fn"))
    out = {"word_p": p, "word_r": r, "word_f1": f}
    empty = (c("pred_count") == 0) & (c("gold_count") == 0)
    for t in IOU_AT:
        out[f"iou_f1_{tag(t)}"] = F.when(empty, 1.0).otherwise(_prf(c(f"iou_tp_{tag(t)}"), c("pred_count"), c("gold_count"))[2])
    for t in CONTAINED_AT:
        out[f"cont_f1_{tag(t)}"] = F.when(empty, 1.0).otherwise(S.f1(S.safe_div(c(f"cont_pred_{tag(t)}"), c("pred_count")), S.safe_div(c(f"cont_gold_{tag(t)}"), c("gold_count"))))
    return rows.withColumns(out)


def summary(rows: DataFrame) -> DataFrame:
    """One row per run over all its rows, from evaluated()."""
    s = lambda n: F.sum(n)
    rnd = lambda x: F.round(x, 6)
    scored = with_scores(rows)
    aggs = [
        F.count("*").alias("n_examples"), F.count_if("is_relevant").alias("n_relevant"), s("word_tp").alias("word_tp"), s("word_fp").alias("word_fp"), s("word_fn").alias("word_fn"),
        F.avg("word_f1").alias("word_macro_f1"), s("pred_count").alias("n_pred"), s("gold_count").alias("n_gold"), s("overlap_hits").alias("hits"), F.avg("latency").alias("mean_latency_s"), F.count_if("failed").alias("errors"),
    ]
    aggs += [x for t in IOU_AT for x in (s(f"iou_tp_{tag(t)}").alias(f"iou_tp_{tag(t)}"), F.avg(f"iou_f1_{tag(t)}").alias(f"iou_macro_{tag(t)}"))]
    aggs += [x for t in CONTAINED_AT for x in (s(f"cont_pred_{tag(t)}").alias(f"cp_{tag(t)}"), s(f"cont_gold_{tag(t)}").alias(f"cg_{tag(t)}"), F.avg(f"cont_f1_{tag(t)}").alias(f"cont_macro_{tag(t)}"))]
    aggs += [s(f"cov_{tag(t)}").alias(f"cov_{tag(t)}") for t in COVERED_AT]
    a = scored.groupBy("run_name").agg(*aggs)
    c = F.col
    wp, wr, wf = _prf(c("word_tp"), c("word_tp") + c("word_fp"), c("word_tp") + c("word_fn"))
    out = [c("run_name"), c("n_examples"), c("n_relevant"), (c("n_examples") - c("n_relevant")).alias("n_irrelevant"), rnd(wp).alias("word_micro_p"), rnd(wr).alias("word_micro_r"), rnd(wf).alias("word_micro_f1"), rnd(c("word_macro_f1")).alias("word_macro_f1")]
    for t in IOU_AT:
        out += [rnd(_prf(c(f"iou_tp_{tag(t)}"), c("n_pred"), c("n_gold"))[2]).alias(f"iou_micro_f1_{tag(t)}"), rnd(c(f"iou_macro_{tag(t)}")).alias(f"iou_macro_f1_{tag(t)}")]
    for t in CONTAINED_AT:
        p, r = S.safe_div(c(f"cp_{tag(t)}"), c("n_pred")), S.safe_div(c(f"cg_{tag(t)}"), c("n_gold"))
        out += [rnd(S.f1(p, r)).alias(f"cont_micro_f1_{tag(t)}"), rnd(c(f"cont_macro_{tag(t)}")).alias(f"cont_macro_f1_{tag(t)}")]
    out += [rnd(S.safe_div(c(f"cov_{tag(t)}"), c("n_gold"))).alias(f"coverage_{tag(t)}") for t in COVERED_AT]
    out += [rnd(S.safe_div(c("hits"), c("n_gold"))).alias("any_overlap_recall"), rnd(S.safe_div(c("n_pred"), c("n_gold"))).alias("over_prediction"), rnd(c("mean_latency_s")).alias("mean_latency_s"), c("errors")]
    return a.select(*out)
