"""Readers and writers of the matrix formats: binary matrix files and text lines."""
