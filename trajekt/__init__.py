"""Motion and multi-sensor trajectory analytics as Spark jobs."""
