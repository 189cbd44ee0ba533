"""Column expressions: grade coercion, the two-parameter logistic model, ranks and correlations."""
