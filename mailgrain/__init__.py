"""Mail analytics as Spark jobs: parse, classify, learn, report, store, stream."""
