"""Column functions: parsing, names, hashing, probabilities, distributions."""
