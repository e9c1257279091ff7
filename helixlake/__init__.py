"""A Spark-native engine for comparative sequence analysis.

Relational steps are DataFrame/SQL plans, iterative steps are driver loops over
tables written to shared storage, and dynamic-programming kernels run as
Arrow-batched Python functions.
"""

__version__ = "0.1.0"
