"""Answer-set metrics: exact matches and overlaps of normalised answers, in per cent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pytext import longest_common


def overlaps(rows: DataFrame, by: str | None = None) -> DataFrame:
    """rows(row_id, pred array<string>, gold array<string>) with p and r: for each answer the longest common substring with the best
    counterpart over its own length, summed. Two empty sides count as one right answer. by: a string column that is kept."""

    keys = ["row_id", *[by] * bool(by)]

    def share(a: list[str], b: list[str]) -> float:
        return sum(max((longest_common(x, y) / len(x) if x else float(not y) for y in b), default=0.0) for x in a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, pred, gold in zip(*[b[c] for c in keys], b["pred"], b["gold"]):
                pred, gold = [list(x) if x is not None else [] for x in (pred, gold)]
                pred, gold = pred or [""], gold or [""]
                exact = float(len(set(pred) & set(gold)))
                out.append((*key, exact, share(pred, gold), share(gold, pred), len(set(pred)), len(set(gold)), len(pred), len(gold)))
            frame = pd.DataFrame(out, columns=[*keys, "exact", "p", "r", "n_pred_set", "n_gold_set", "n_pred", "n_gold"])
            yield frame.astype({by: object}) if by else frame

    return rows.select(*keys, "pred", "gold").mapInPandas(run, f"row_id bigint, {f'`{by}` string, ' if by else ''}exact double, p double, r double, n_pred_set int, n_gold_set int, n_pred int, n_gold int")


def summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Exact match and overlap precision, recall and F1 over all rows, or those of each value of the string `by`, times 100; denominators are at least 1."""
    a = overlaps(rows, by).groupBy(*[by] * bool(by)).agg(*[F.sum(c).alias(c) for c in ("exact", "p", "r", "n_pred_set", "n_gold_set", "n_pred", "n_gold")])

    def prf(tp_p: str, tp_r: str, n_p: str, n_r: str, name: str) -> list:
        p, r = F.col(tp_p) / F.greatest(F.lit(1), F.coalesce(F.col(n_p), F.lit(0))), F.col(tp_r) / F.greatest(F.lit(1), F.coalesce(F.col(n_r), F.lit(0)))
        f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        return [F.round(100 * F.coalesce(x, F.lit(0.0)), 2).alias(f"{name}_{n}") for x, n in ((p, "p"), (r, "r"), (f, "f1"))]

    return a.select(*[by] * bool(by), *prf("exact", "exact", "n_pred_set", "n_gold_set", "em"), *prf("p", "r", "n_pred", "n_gold", "overlap"))
