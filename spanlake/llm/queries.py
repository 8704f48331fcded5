"""The queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

from .sql import SQL

_NAMES = {
    "p1_splits": ("p1_found", "p1_splits", "p1_report", "p1_invariants"),
    "p2_cut": ("p2_found", "p2_pieces", "p2_invariants"),
    "p3_scans": ("p3_found", "p3_repaired"),
    "p4_near": ("p4_found", "p4_links", "p4_groups"),
    "p5_overlap": ("p5_found", "p5_report"),
    "p6_pack": ("p6_pack", "p6_report", "p6_invariants"),
    "p7_mix": ("p7_mix", "p7_report", "p7_invariants"),
    "p8_garbled": ("p8_found", "p8_restored"),
}


def queries() -> dict:
    return {n: getattr(import_module(f"{__package__}.{m}"), n) for m, names in _NAMES.items() for n in names}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
