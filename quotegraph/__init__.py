"""quotegraph: building, cleaning, deduplicating and searching a graph of quotations on Spark."""
