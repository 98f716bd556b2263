"""Reading order, tables and Markdown of one document, in plain Python: folds whose state depends on what was merged before."""
