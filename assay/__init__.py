"""Exploratory analytics on Spark DataFrames: profile, clean, analyse, model, answer, rank."""
