"""Operators for building language-model training data, each as Spark jobs."""
