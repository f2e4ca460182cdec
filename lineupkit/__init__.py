"""lineupkit: roster analytics and training-data preparation as Spark jobs."""
