"""Training-data operators: packing, deduplication, scans, extraction, media.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and names its columns by parameter, so tables may carry extra
columns of any name.
"""
