"""millrace: analytics of media processing and of text corpora as Spark DataFrame operators."""
