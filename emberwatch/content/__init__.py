"""Rules and dimension data that operators are run with."""
