"""skein: code-graph analytics as ordinary Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing here keeps
state of its own between calls.
"""
