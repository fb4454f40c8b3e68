"""Column expressions: dense vectors, boxes, text labels and small array kernels."""
