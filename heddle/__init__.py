"""heddle: company-intelligence and corpus operators as declarative Spark plans."""
