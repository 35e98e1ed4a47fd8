"""Iterative and composed plans: clustering, product quantization, indexes."""
