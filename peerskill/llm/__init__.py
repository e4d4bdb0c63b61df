"""Training-data operators: ten document-scale jobs, their registered queries and SQL oracles.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it is present."""
