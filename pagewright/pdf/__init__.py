"""A reader of PDF files in plain Python (zlib and re alone), for use inside Spark's Arrow functions."""
