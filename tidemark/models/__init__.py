"""Models fitted on aggregates that Spark computes."""
