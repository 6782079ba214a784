"""Plans: test verdicts, suites, layered checks and result reports built from the operators."""
