"""Table operators, grouped by the step of an evaluation run they serve."""
