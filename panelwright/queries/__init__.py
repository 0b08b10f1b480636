"""Registered queries of the panel engine, with their SQL twins."""

from . import controls, factors, inference, ledger, pairs, panel, reports, series, signals, studies

QUERIES: dict = panel.QUERIES
ORACLES: dict = panel.ORACLES
