"""Spark-first market-risk analytics: panels, pricing, VaR / ES estimators and backtests."""
