"""Training-data operators: deduplication, decontamination, mixing, filtering, counting.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; kernels that SQL cannot express run over Arrow batches.
"""
