"""The pipeline language: parser and lowering to DataFrames."""
