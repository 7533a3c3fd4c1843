"""Spark-native operators for finding harmful edits in crowd-sourced map data."""

__version__ = "0.1.0"
