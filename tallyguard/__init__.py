"""Spark-native transaction risk analytics: features, rules, scoring, cases, metrics."""
