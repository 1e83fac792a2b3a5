"""Analytics on time-stamped observations at many locations, as Spark jobs."""
