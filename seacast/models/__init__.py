"""MLlib training, scoring, search and metric operators."""
