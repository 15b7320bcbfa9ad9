"""Column functions: text views, similarities, scores."""
