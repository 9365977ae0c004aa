"""docledger: document-corpus operators expressed as Spark DataFrame transformations."""
