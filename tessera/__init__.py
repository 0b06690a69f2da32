"""Context selection and ensemble analytics on Spark."""
