"""Optical-bench capture analytics expressed as Spark DataFrame plans."""
