"""pagewright: document-layout and text-alignment analytics on Spark DataFrames."""
