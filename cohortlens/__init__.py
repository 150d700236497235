"""Repeated-measures cohort analytics and prediction on PySpark.

Every public operator takes and returns DataFrames (or a fitted ``pyspark.ml``
model); nothing is collected except result rows whose number is bounded by the
number of measures, classes or model coefficients.
"""
