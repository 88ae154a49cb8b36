"""Network embedding over edge tables split among parties, written as Spark DataFrame plans."""
