"""hammerline: collectibles price analytics and corpus preparation as Spark jobs."""
