"""Link analytics and training-data preparation as Spark DataFrame plans."""
