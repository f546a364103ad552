"""Training-data operators. Nothing outside this subpackage (but __spark_entry__ and corpus_pipeline) imports it."""
