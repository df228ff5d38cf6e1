"""Company and bank details from documents, as Spark DataFrame stages."""
