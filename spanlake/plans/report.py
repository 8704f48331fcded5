"""Plain-text tables of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, columns: list[str] | None = None, most: int = 200) -> str:
    """The first `most` rows as aligned text, numbers with four places; a last line says so if there are more."""
    names = columns or df.columns
    rows = [[f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.select(*names).limit(most + 1).collect()]
    more, rows = len(rows) > most, rows[:most]
    width = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
    lines = ["  ".join(n.ljust(w) for n, w in zip(names, width)), "  ".join("-" * w for w in width)]
    return "\n".join([*lines, *("  ".join(v.ljust(w) for v, w in zip(r, width)) for r in rows), *([f"… more than {most} rows"] if more else [])])


def comparison(summary: DataFrame) -> str:
    """Runs side by side in eleven columns."""
    cols = ["run_name", "n_examples", "word_micro_p", "word_micro_r", "word_micro_f1", "iou_micro_f1_50", "cont_micro_f1_80", "coverage_80", "any_overlap_recall", "over_prediction", "mean_latency_s"]
    return table(summary.orderBy("run_name"), cols)


def recall(df: DataFrame) -> str:
    return table(df.orderBy("search_type", "k"))
