"""Attesto: a Spark-native engine for searching and analysing dated, sourced documents."""
