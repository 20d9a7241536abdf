"""blobloom: data operators for blobs, ordered sequences, histograms and palettes on Spark.

Every operator is a plain function from DataFrame(s) to DataFrame, or from
Column(s) to Column, and takes the names of the columns it works on.
"""
