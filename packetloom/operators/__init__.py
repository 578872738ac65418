"""DataFrame operators: ranking, fusion, rules, scoring, learning, metrics."""
