"""tallyframe: batch reconstruction, verification and summary of tabular score cards on Spark."""
