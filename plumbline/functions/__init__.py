"""Column builders and the numeric functions that grouped Arrow operators use."""
