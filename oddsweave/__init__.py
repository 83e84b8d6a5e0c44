"""oddsweave: price consensus and entity matching as Spark jobs."""
