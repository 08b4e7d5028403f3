"""docquarry: document retrieval and question answering on PySpark DataFrames."""
