"""Column functions: text, commands, paths, scores."""
