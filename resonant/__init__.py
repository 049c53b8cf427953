"""Spark-first analytics over ordered sample series: measures, detectors, rules, comparison and evaluation."""
