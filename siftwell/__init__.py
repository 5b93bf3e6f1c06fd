"""siftwell: message cleaning, features, classifiers and cost-sensitive scores as Spark jobs."""
