"""Whole jobs composed of operators: archive to store, store to aggregates, excursions, backtests."""
