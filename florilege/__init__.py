"""florilege: taxonomic name data and corpus preparation on Apache Spark."""
