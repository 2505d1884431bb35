"""Learned scorers: gradients per partition, summed by Spark."""
