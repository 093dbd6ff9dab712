"""Tables of questions in, tables of cited answers out, on Spark."""
