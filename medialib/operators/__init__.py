"""One module per operator family; each function is DataFrame in, DataFrame out."""
