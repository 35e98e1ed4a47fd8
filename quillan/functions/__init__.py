"""Column functions: distances, vectors, sets, bits and quantizers."""
