"""Spark ML estimators for the forecasting ensembles."""
