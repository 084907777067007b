"""The registered queries: inputs derived from the test tables, one query per operator, SQL twins."""
