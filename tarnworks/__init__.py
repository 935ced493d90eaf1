"""Tarnworks: dependency graphs, work-item trees and run telemetry on PySpark DataFrames."""
