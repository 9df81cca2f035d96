"""techpub_spark: governed retrieval analytics over technical publications, as DataFrame transformations."""
