"""Training-data operators: sampling, counting, tagging, filtering, matching and packing of text corpora."""
