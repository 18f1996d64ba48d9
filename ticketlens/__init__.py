"""Spark-first analytics over operational ticket tables."""
