"""Feature engineering and modelling as plain functions over Spark DataFrames."""
