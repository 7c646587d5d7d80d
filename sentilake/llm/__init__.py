"""Training-data operators: corpus-scale jobs and the queries that apply them."""
