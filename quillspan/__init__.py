"""quillspan: session and corpus analytics on PySpark DataFrames."""
