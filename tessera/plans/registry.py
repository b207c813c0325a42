"""Queries and their DuckDB SQL, by name."""

from __future__ import annotations

from tessera.plans import bpe, chat, corpus, metrics, preference, reports, sampling, sinks, streams, tensors
from tessera.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bpe", "chat", "corpus", "metrics", "preference", "reports", "sampling", "sinks", "streams", "tensors"]
