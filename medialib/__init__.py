"""medialib: analytics over many personal media libraries, on Spark.

Every public operator takes DataFrames and parameters and returns a DataFrame
(or a pair of them). Nothing is collected to the driver; the only scalars read
are convergence counts in the iterative operators.
"""
