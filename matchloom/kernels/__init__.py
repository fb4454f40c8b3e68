"""Pixel kernels in numpy, and jobs that run them over tables of tiles."""
