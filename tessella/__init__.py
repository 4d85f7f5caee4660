"""Detection post-processing and compositional agreement on Spark."""
