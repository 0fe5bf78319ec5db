"""marlstone: text-risk, similarity and eligibility analytics on PySpark DataFrames."""
