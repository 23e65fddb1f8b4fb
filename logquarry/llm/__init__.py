"""Training-data operations: filters, near-duplicate removal, tokenising and packing of text corpora."""
