"""Multi-resolution geometry tables on Spark: layout builder, viewport planner and geometry functions."""
