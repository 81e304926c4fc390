"""Spark-native curation of text datasets and evaluation of model outputs."""
