"""Panel forecasting on Spark DataFrames: validate, split, featurise, impute, fit, blend, score."""
