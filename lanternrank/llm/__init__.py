"""Training-data operators: thirteen first-class components for corpus preparation.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; what must be shared between executors goes through
``common.shared_dir``.
"""
