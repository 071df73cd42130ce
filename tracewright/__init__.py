"""Finds and repairs ambiguous activity labels in process event logs, on Spark."""
