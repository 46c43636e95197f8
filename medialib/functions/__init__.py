"""Column helpers and DataFrame building blocks shared by the operators."""
