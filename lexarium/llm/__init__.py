"""Training-data operators: every module holds one operator and its thin query."""
