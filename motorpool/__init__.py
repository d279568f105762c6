"""Fleet analytics for vehicle rental, written as Spark DataFrame functions."""
