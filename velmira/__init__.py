"""velmira: a Spark-first engine for curating, labelling and scoring document-derived record sets."""
