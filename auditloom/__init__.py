"""Web-page audits as Spark DataFrame jobs over many sites at once."""
