"""Training-data operators. Nothing else in this library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("licenses", "ctw", "sharding", "pii", "simhash", "decontaminate", "quality", "bpe", "token_counts", "toxicity", "periods", "piece_bpe", "infill")


def registered(what: str) -> dict:
    """The QUERIES or ORACLES of all operator modules."""
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), what))
    return out
