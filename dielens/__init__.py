"""Wafer-probe and final-test analytics as ordinary Spark DataFrame operators."""
